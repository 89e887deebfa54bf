"""Model choice over distinct rows against the same rows one by one."""

import inspect
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from emberlog.functions.scoring import FEATURES
from emberlog.operators import learn as ml

COPIES = 30


@pytest.fixture(scope="module")
def samples(spark):
    """150 different readings, the first of them once, the others 30 times."""
    r = random.Random(3)
    rows = []
    for i in range(150):
        score = round(r.uniform(0, 12), 2)
        label = int(score + r.uniform(-4, 4) > 6)
        values = [score, r.random(), r.random() * 3, r.randrange(1, 6), r.randrange(20, 200), r.randrange(12, 60), True, r.random() < 0.5, r.random() < 0.2, label == 1, r.randrange(1, 9), r.choice([None, r.randrange(10**9)]), r.random() < 0.7, r.random() < 0.5]
        rows += [(len(rows) + j, label, *values) for j in range(COPIES if i else 1)]
    kinds = dict.fromkeys(FEATURES, "double") | dict.fromkeys(("has_digit", "has_suffix", "has_decimal", "starts_with_nonzero", "value_in_range", "is_plausible"), "boolean")
    kinds |= dict.fromkeys(("member_count", "width", "height", "text_length"), "int") | {"parsed_value": "bigint"}
    return spark.createDataFrame(rows, "ordinal bigint, label int, " + ", ".join(f"{f} {kinds[f]}" for f in FEATURES))


def test_choice_runs_over_distinct_rows(samples, monkeypatch):
    """No table holds a row per copy, and the regression is the one fitted and judged row by row."""
    written, cut = [], ml.cut_lineage

    def counting(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(ml, "cut_lineage", counting)
    _, _, scores = ml.choose_model(samples, trees=2, folds=2, rounds=1)
    assert written and max(written) <= 300  # 150 readings, two sides
    rows = ml.vector_inputs(samples, presence=False)
    left, right = ml.split(rows)
    plain = Pipeline(stages=[
        VectorAssembler(inputCols=ml.INPUTS, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol="label", weightCol="weight", maxIter=1000, regParam=1.0 / left.count()),
    ]).fit(ml.balanced(left))
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0).evaluate(plain.transform(right))
    mine = {r.model: r.test_f1 for r in scores.collect()}
    assert set(mine) == {"logistic_regression", "random_forest", "gradient_boosting"}
    assert mine["logistic_regression"] == pytest.approx(f1, abs=0.005)


def test_copies_are_kept(samples):
    rows = ml.distinct_rows(samples, presence=False)
    assert rows.agg(F.sum("copies")).first()[0] == samples.count()
    left, right = ml.split(samples)
    assert {r.in_test: r.n for r in rows.groupBy("in_test").agg(F.sum("copies").alias("n")).collect()} == {False: left.count(), True: right.count()}
    folds = rows.select("copies", *[ml._in_fold(i, 5, 42).alias(f"f{i}") for i in range(5)]).collect()
    assert all(sum(r[1:]) == r.copies and max(r[1:]) - min(r[1:]) <= 1 for r in folds)
    lots = ml._lots(rows).agg(F.sum("copies"), F.count("*")).first()
    assert lots[0] == pytest.approx(samples.count()) and rows.count() < lots[1] < samples.count()


def test_scaler_counts_copies(samples):
    rows = ml.distinct_rows(samples, presence=False)
    scaled = ml._scaler(rows).transform(rows)
    n = samples.count()
    for c in ("v_line_score", "v_parsed_value"):
        x = F.col(f"s_{c}")
        mean, square = scaled.agg(F.sum(F.col("copies") * x), F.sum(F.col("copies") * x * x)).first()
        assert mean / n == pytest.approx(0, abs=1e-9) and square / (n - 1) == pytest.approx(1)
    assert scaled.filter("s_v_has_digit <> 0").isEmpty()  # one value only


def test_query_runs_all_trees_folds_and_rounds(spark, monkeypatch):
    """The registered query leaves out no part of the comparison: 100 trees, five folds, 100 boosting rounds, all rows."""
    from emberlog.plans import catalog
    from emberlog.plans import catalog_learn as cl

    asked, choose = [], ml.choose_model

    def noted(*args, **kw):
        bound = inspect.signature(choose).bind(*args, **kw)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return None, None, spark.range(1)

    monkeypatch.setattr(ml, "choose_model", noted)
    sf = "/root/testdata/sf0.001"
    catalog.QUERIES["m5_choose_model"](spark, sf)
    (got,) = asked
    assert (got["trees"], got["folds"], got["rounds"]) == (100, 5, 100)
    read = cl.scored_readings(spark, sf).filter(F.col("is_plausible") & (F.col("confidence") >= 0.6)).count()
    assert got["samples"].count() >= read + cl.training_rows(spark, sf).count()


def test_all_rounds_are_fitted_and_fits_share_no_properties(samples, monkeypatch):
    """Every boosting model has a tree for each round; each fit and scaler has local properties of its own."""
    wrapped, wrap, boosted = [], ml.inheritable_thread_target, []
    monkeypatch.setattr(ml, "inheritable_thread_target", lambda s: wrapped.append(1) or wrap(s))

    class Boosting(ml.GBTClassifier):
        def _fit(self, rows):
            model = super()._fit(rows)
            boosted.append(model.getNumTrees)
            return model

    monkeypatch.setattr(ml, "GBTClassifier", Boosting)
    ml.choose_model(samples, trees=2, folds=2, rounds=4)
    assert boosted == [4] * 3 and len(wrapped) == 3 + 9  # two folds and the whole, three models
