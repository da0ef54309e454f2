"""Every corpus query has a SQL twin or a named test against brute force."""

import importlib

import pytest

from cohortloom.llm import queries

#: Queries that SQL cannot express, and the test that holds each against a plain version, a round trip or the library.
TESTED = {
    "op1_packing": "test_tokens.test_pieces_of_documents",
    "op2_pii": "test_pii.test_card_against_a_plain_network",
    "op4_suffix_dedup": "test_suffix_dedup.test_documents",
    "op5_winnowing": "test_winnowing.test_documents",
    "op6_token_counts": "test_tokens.test_count_documents",
    "op7_simhash": "test_simhash.test_documents",
    "op8_quality": "test_quality.test_verdicts_against_plain_quantiles",
    "op10_html_extract": "test_html.test_pages_of_the_table",
    "op11_token_planes": "test_token_planes.test_query_against_the_library",
}


def test_every_query_is_held_against_something():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) | set(TESTED)
    assert not set(queries.ORACLE_SQL) & set(TESTED)


@pytest.mark.parametrize("name", TESTED.values())
def test_named_tests_exist(name):
    module, test = name.split(".")
    assert callable(getattr(importlib.import_module(module), test))
