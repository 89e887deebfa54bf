"""Classifier jobs: sample extraction, training, model choice, importance, scoring."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.functions.scoring import FEATURES, feature_columns
from emberlog.operators.stats import classifier_report
from emberlog.session import cut_lineage

INPUTS = [f"v_{f}" for f in FEATURES]


def pseudo_truth(stable: DataFrame, key: str = "session_id") -> DataFrame:
    """Stable hits as ground truth for later runs."""
    return stable.select(
        key, F.col("frame_index").alias("frame"), F.col("parsed_value").alias("value"), F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.lit("direct").alias("damage_type")
    )


def extract_samples(readings: DataFrame, confident: float = 0.6, doubtful: float = 0.3) -> DataFrame:
    """Labelled samples from readings: clear hits 1, clear misses 0, the rest is left out.

    Width and height are plain differences here, the fill ratio comes from the line score and
    the member count is 1, as the reading table holds neither pixels nor members.
    """
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    conf, ok = F.col("confidence"), F.coalesce("is_plausible", F.lit(False))
    label = F.when((conf >= confident) & ok, 1).when((conf < doubtful) | ~ok, 0)
    cols = feature_columns(F.col("score"), F.lit(1), width, height, F.lit(0), F.col("raw_text"))
    cols["fill_ratio"] = F.least(F.col("score") / 12.0, F.lit(1.0))
    cols["parsed_value"] = F.col("parsed_value")
    cols["value_in_range"] = F.coalesce(F.col("parsed_value").between(100, 100_000_000), F.lit(False))
    cols["is_plausible"] = ok
    keep = [c for c in ("session_id", "ordinal") if c in readings.columns]
    out = readings.select(*keep, label.alias("label"), *[c.alias(n) for n, c in cols.items()])
    return out.filter(F.col("label").isNotNull())


def collected_samples(hits: DataFrame) -> DataFrame:
    """Features of collected hits (all positive); unknown geometry takes fixed average values."""
    t, v = F.coalesce("text", F.lit("")), F.col("value")
    return hits.select(
        F.lit(1).alias("label"), (F.col("confidence") * 12).alias("line_score"), F.lit(0.35).alias("fill_ratio"), F.lit(3.0).alias("aspect_ratio"), F.lit(3).alias("member_count"),
        F.lit(80).alias("width"), F.lit(24).alias("height"), t.rlike("[0-9]").alias("has_digit"), F.upper(t).rlike("[KMB]").alias("has_suffix"), t.contains(".").alias("has_decimal"),
        t.rlike("^[1-9]").alias("starts_with_nonzero"), F.length(t).alias("text_length"), v.alias("parsed_value"), F.coalesce(v.between(100, 100_000_000), F.lit(False)).alias("value_in_range"), F.lit(True).alias("is_plausible"),
    )


def negatives(samples: DataFrame, share: float = 1 / 3, seed: int = 42) -> DataFrame:
    """Unlikely-looking negatives, about ``share`` of the input rows, made from seeded noise on
    the row's own hash so that a recomputed task makes the same rows."""
    keyed = samples.select(F.xxhash64(*samples.columns, F.lit(seed)).alias("_key"))

    def uniform(i: int):
        return F.pmod(F.xxhash64("_key", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0

    def between(i: int, lo: float, hi: float):
        return uniform(i) * (hi - lo) + lo

    def whole(i: int, lo: int, hi: int):
        return F.floor(between(i, lo, hi + 1)).cast("int")

    return keyed.filter(uniform(0) < share).select(
        F.lit(0).alias("label"), between(1, 2.0, 6.0).alias("line_score"), between(2, 0.5, 0.9).alias("fill_ratio"), between(3, 0.8, 1.5).alias("aspect_ratio"), whole(4, 1, 2).alias("member_count"),
        whole(5, 100, 300).alias("width"), whole(6, 100, 300).alias("height"), (uniform(7) < 0.5).alias("has_digit"), F.lit(False).alias("has_suffix"), F.lit(False).alias("has_decimal"),
        F.lit(False).alias("starts_with_nonzero"), whole(8, 5, 15).alias("text_length"), F.lit(None).cast("bigint").alias("parsed_value"), F.lit(False).alias("value_in_range"), F.lit(False).alias("is_plausible"),
    )


def vector_inputs(samples: DataFrame, presence: bool = True) -> DataFrame:
    """Numeric inputs; the parsed value enters as present / absent, or raw with 0 for missing."""
    value = F.col("parsed_value").isNotNull().cast("double") if presence else F.coalesce(F.col("parsed_value").cast("double"), F.lit(0.0))
    return samples.withColumns({f"v_{f}": value if f == "parsed_value" else F.col(f).cast("double") for f in FEATURES})


def prepared(samples: DataFrame, presence: bool = True) -> DataFrame:
    """Narrow numeric training rows, written once: every optimiser pass re-reads them instead of
    repeating the text features, also after the loss of an executor."""
    keep = [c for c in ("ordinal",) if c in samples.columns]
    return cut_lineage(vector_inputs(samples, presence).select(*keep, "label", *INPUTS))


def balanced(samples: DataFrame, copies: str | None = None) -> DataFrame:
    """Adds ``weight`` = n / (classes * class size), from one count per class; a row counts ``copies`` times."""
    per_class = samples.groupBy("label").agg((F.sum(copies) if copies else F.count("*")).alias("_c"))
    counts = per_class.agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"), F.collect_list(F.struct("label", "_c")).alias("_rows"))
    w = counts.select("_t", "_k", F.inline("_rows")).select("label", (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return samples.join(F.broadcast(w), "label")  # one row per class


def _place(key: str, seed: int) -> Column:
    """A number from 0 to 1 that hangs on the row's key alone."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) / 10_000.0


def split(samples: DataFrame, test_share: float = 0.2, seed: int = 42, key: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Train / test by row hash: the same row falls on the same side on every recomputation and
    both classes are divided in the same proportion."""
    marked = samples.withColumn("_u", _place(key, seed))
    return marked.filter(F.col("_u") >= test_share).drop("_u"), marked.filter(F.col("_u") < test_share).drop("_u")


def _assembler(out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=INPUTS, outputCol=out)


def train(samples: DataFrame, scale: bool = False, reg: float | None = None) -> PipelineModel:
    """Balanced logistic regression.  ``reg`` defaults to 1/n, which corresponds to unit inverse
    regularisation on the summed loss."""
    rows = cut_lineage(balanced(prepared(samples, presence=not scale)))
    if reg is None:
        reg = 1.0 / max(rows.count(), 1)
    stages = [_assembler("raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    stages.append(LogisticRegression(labelCol="label", weightCol="weight", maxIter=1000, regParam=reg, standardization=False))
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, samples: DataFrame, threshold: float = 0.5, scale: bool = False) -> DataFrame:
    """Adds probability, decision and 0/1 prediction at ``threshold``."""
    out = model.transform(vector_inputs(samples, presence=not scale))
    p = vector_to_array("probability")[1]
    keep = [F.col(c) for c in samples.columns]
    return out.select(*keep, p.alias("hit_probability")).withColumns(
        {"decision": F.when(F.col("hit_probability") >= threshold, "hit").otherwise("no_hit"), "predicted": (F.col("hit_probability") >= threshold).cast("int")}
    )


def train_report(samples: DataFrame, test_share: float = 0.2, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Scaled regression on the training side, judged on the test side, then refitted on all rows."""
    left, right = split(samples, test_share, seed)
    report = classifier_report(predict(train(left, scale=True), right, scale=True))
    return train(samples, scale=True), report


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Features by absolute coefficient (fourteen rows)."""
    coef = [float(c) for c in model.stages[-1].coefficients.toArray()]
    df = spark.createDataFrame(list(zip(FEATURES, coef)), "feature string, coefficient double")
    return df.withColumn("importance", F.abs("coefficient")).orderBy(F.desc("importance"), "feature")


def distinct_rows(samples: DataFrame, presence: bool = True, test_share: float = 0.2, seed: int = 42, key: str = "ordinal") -> DataFrame:
    """The numeric rows of ``prepared`` with the side of ``split`` (``in_test``), equal ones of a side as one row with ``copies``."""
    rows = vector_inputs(samples, presence).withColumn("in_test", _place(key, seed) < test_share)
    return cut_lineage(rows.groupBy("in_test", "label", *INPUTS).agg(F.count("*").alias("copies")))


def _in_fold(fold: int, folds: int, seed: int) -> Column:
    """How many of a row's copies lie in ``fold``: they are dealt in turn, the first to a fold that hangs on the row."""
    first = F.pmod(F.xxhash64("label", *INPUTS, F.lit(seed)), F.lit(folds))
    return F.floor(F.col("copies") / folds) + (F.pmod(F.lit(fold) - first, F.lit(folds)) < F.col("copies") % folds).cast("bigint")


def _n_lots() -> Column:
    return F.ceil(F.sqrt("copies")).cast("int")


def _lots(rows: DataFrame) -> DataFrame:
    """Copies in lots, as many as the square root of their number, for estimators that draw rows at random.  A few copies
    are drawn almost one by one; of many, whole lots are in or out, and the weights of the lots add up to the copies."""
    dealt = rows.withColumn("_lots", _n_lots()).withColumn("_lot", F.explode(F.sequence(F.lit(1), F.col("_lots"))))
    return dealt.withColumn("copies", F.col("copies") / F.col("_lots")).drop("_lot", "_lots")


def _scaler(rows: DataFrame) -> SQLTransformer:
    """``StandardScaler`` with means, for rows that count ``copies`` times: inputs ``s_...`` of mean 0 and deviation 1."""
    n = F.sum("copies")
    size, *means = rows.agg(n, *[F.sum(F.col("copies") * F.col(c)) / n for c in INPUTS]).first()
    squares = rows.agg(*[F.sum(F.col("copies") * (F.col(c) - m) ** 2) for c, m in zip(INPUTS, means)]).first()
    deviations = [(q / max(size - 1, 1)) ** 0.5 for q in squares]
    scaled = [f"({c} - ({m!r}D)) * ({1 / d if d else 0.0!r}D) AS s_{c}" for c, m, d in zip(INPUTS, means, deviations)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def choose_model(samples: DataFrame, trees: int = 100, folds: int = 5, seed: int = 42, rounds: int = 100, parallelism: int = 2) -> tuple[str, object, DataFrame]:
    """Logistic regression, random forest and boosted trees compared by the F1 of the positive class, cross-validated
    and on the test side; the best test F1 wins.  The regression and the forest weigh the classes.  Returns (name, model, scores).

    Readings repeat, so all fits and scores run over distinct rows that count as often as they occur.  The fits do not
    depend on each other; ``parallelism`` of them run at a time, as one alone is a chain of short jobs.
    """
    rows = distinct_rows(samples, presence=False, seed=seed)
    left, right = rows.filter(~F.col("in_test")), rows.filter("in_test")
    size, lots = left.agg(F.sum("copies"), F.sum(_n_lots())).first()
    # The rows are few bytes, so their work is spread by their number.
    left = cut_lineage(balanced(left, "copies").repartition((lots or 0) // 20_000 + 1))
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0, weightCol="copies")
    penalty = 1.0 / max(size or 0, 1)  # unit inverse regularisation of the summed loss
    candidates = {
        "logistic_regression": LogisticRegression(labelCol="label", weightCol="_weight", maxIter=1000, regParam=penalty),
        "random_forest": RandomForestClassifier(labelCol="label", weightCol="_weight", numTrees=trees, seed=seed),
        "gradient_boosting": GBTClassifier(labelCol="label", weightCol="copies", maxIter=rounds, seed=seed),
    }
    assembler = VectorAssembler(inputCols=[f"s_{c}" for c in INPUTS], outputCol="features")
    # The rows of each fold beside those it is judged on; the last is the whole training side beside the test side.
    sides = [
        tuple(left.withColumn("copies", n).filter(F.col("copies") > 0) for n in (F.col("copies") - _in_fold(i, folds, seed), _in_fold(i, folds, seed)))
        for i in range(folds)
    ] + [(left, right)]

    def fit(task: tuple) -> tuple[PipelineModel, float]:
        name, scaler, (learnt, judged) = task
        learnt = (_lots(learnt) if name == "random_forest" else learnt).withColumn("_weight", F.col("weight") * F.col("copies"))
        model = Pipeline(stages=[scaler, assembler, candidates[name]]).fit(learnt)
        return model, float(f1.evaluate(model.transform(judged)))

    spark = samples.sparkSession

    def at_a_time(f: Callable, tasks: list) -> list:
        # Each task is wrapped by itself: tasks wrapped together would share, and overwrite, the local properties of their jobs.
        calls = [inheritable_thread_target(spark)(partial(f, task)) for task in tasks]
        with ThreadPoolExecutor(parallelism) as pool:
            return list(pool.map(lambda call: call(), calls))

    scalers = at_a_time(_scaler, [learnt for learnt, _ in sides])
    fitted = at_a_time(fit, [(name, scaler, side) for name in candidates for scaler, side in zip(scalers, sides)])
    scores, models = [], {}
    for i, name in enumerate(candidates):
        *cross, (models[name], test) = fitted[i * (folds + 1) : (i + 1) * (folds + 1)]
        scores.append((name, sum(score for _, score in cross) / folds, test))
    best = max(scores, key=lambda s: s[2])[0]
    return best, models[best], spark.createDataFrame(scores, "model string, cv_f1 double, test_f1 double")
