"""From raw cohorts to the validation report, on the smallest tables."""

from pyspark.sql import functions as F

from cohortloom.operators.scale import keep
from cohortloom.plans import derived as d
from cohortloom.plans import training, validation

GRID = {"nrounds": [1, 3], "eta": [0.3], "max_depth": [2], "gamma": [0.0], "colsample": [1.0], "subsample": [1.0]}


def test_end_to_end(spark, sf):
    clinical = d.basket_clinical(spark, sf)
    scores, valid = training.training_features(
        d.basket_tpm(spark, sf), clinical, d.basket_signatures(spark, sf), d.basket_signature_info(spark),
        d.basket_selected(spark, sf), cohorts=None,
    )
    scores = keep(scores)
    per_study = scores.groupBy("study").agg(F.sort_array(F.collect_set("signature")).alias("s"), F.count_if(F.col("score").isNull()).alias("n"))
    lists = per_study.collect()
    assert len(lists) == 3 and len({tuple(r.s) for r in lists}) == 1 and all(r.n == 0 for r in lists)
    assert not {"UNK", "BAD", "S4"} & set(lists[0].s)

    out = training.train_local_models(scores, valid, GRID)
    summary = out["summary"].collect()
    assert len(summary) == 3 and all(0.5 <= r.best_auc <= 1 for r in summary)

    predicted = keep(validation.predictions(scores, clinical, out["model"], out["tree_node"], "PIO"))
    assert predicted.select("model_id").distinct().count() == 5
    report = validation.validate(predicted, 5)
    aucs = report["auc_long"].collect()
    assert len(aucs) == 3 * 5 and all(0 <= r.auc <= 1 for r in aucs)
    assert report["intervals"].count() == 6
    assert report["local_summary"].count() == 3
    assert report["curves"].filter("model = 'Local Model'").count() == 3 * 150
