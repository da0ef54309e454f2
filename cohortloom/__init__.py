"""Cohort scoring, federated tree training and model evaluation as Spark jobs.

Study, signature, model, parameter setting and bootstrap replicate are grouping
keys of DataFrame operators; nothing is looped over them.
"""
