"""Golden rows for cleaning, parsing, plausibility, display."""

import pytest
from pyspark.sql import functions as F

from emberlog.functions import geometry as geo, scoring as sc, text as tx

PARSED = {
    "246k": 246_000, "10.3M": 10_300_000, "2B": 2_000_000_000, "1,000K": 1_000_000, "1,234M": 1_234_000_000, "45,6M": 45_600_000, "75": 75,
    "1.005K": 1004, "": None, "abc": None, "K": None, ".": None, "1.2.3K": None, " 1 234 ": 1234, "99999.999B": 99_999_999_000_000,
}
PLAUSIBLE = {
    "1": False, "1,23": False, "0": False, "0K": False, "363500M": False, "1,000K": True, "246K": True, "10.3M": True, "75": True, "1,5K": True, "": False,
    "1,234": True, "12345678901": False, "Helm": False,
}


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("text"))).collect()]


def test_parse(spark):
    assert column(spark, PARSED, tx.parse_value) == list(PARSED.values())


def test_plausible(spark):
    assert column(spark, PLAUSIBLE, tx.is_plausible) == list(PLAUSIBLE.values())


def test_read_texts_agrees_with_single_expressions(spark):
    df = spark.createDataFrame([(t,) for t in [*PARSED, *PLAUSIBLE]], "text string")
    out = tx.read_texts(df).withColumns({"v": tx.parse_value(F.col("text")), "p": tx.is_plausible(F.col("text"))}).collect()
    assert all(r.parsed_value == r.v and r.is_plausible == r.p for r in out)


def test_clean_and_classify(spark):
    assert column(spark, [" 1O S\n", "x12,5K!"], tx.clean_text) == ["105", "12,5K"]
    assert column(spark, ["", "35 Gold", "12K", "Helm", "??", "1,5k"], tx.classify) == ["unknown", "gold", "damage", "item", "unknown", "damage"]


def test_display(spark):
    nums = [0, 999, 1000, 1250, 1350, 1450, 10_300_000, 2_000_000_000, 1_050_000_000_000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(nums)], "i int, n bigint").orderBy("i")
    assert [r[0] for r in df.select(tx.short_number(F.col("n"))).collect()] == ["0", "999", "1K", "1.2K", "1.4K", "1.4K", "10.3M", "2B", "1.1T"]
    assert [r[0] for r in df.select(tx.clock(F.col("n"))).collect()][:3] == ["00:00", "00:00", "00:01"]


def test_top_frame_count(spark):
    df = spark.createDataFrame([(0,), (30,), (120,), (400,)], "n int")
    assert [r[0] for r in df.select(geo.top_frame_count(F.col("n"))).collect()] == [6, 6, 14, 30]


@pytest.mark.parametrize("a,b,same", [(905, 907, True), (8_000_000, 9_000_000, False), (100, 106, False), (1_000_000, 1_030_000, True), (2000, 2031, False), (2000, 2030, True)])
def test_values_merge(spark, a, b, same):
    row = spark.range(1).select(sc.values_merge(F.lit(a), F.lit(b)), sc.values_merge(F.lit(b), F.lit(a))).first()
    assert tuple(row) == (same, same)


def test_damage_beyond_a_long_is_exact(spark, tmp_path):
    """Long numbers add up to more than a long holds: by one token's count, and by the sum."""
    from emberlog.plans.catalog import QUERIES

    rows = [(1, "9000000000000000000 9000000000000000000 1K", "en", "s", 1), (2, "8000000000000000000 5 ab", "en", "s", 1), (3, "7", "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.lang, r.kind): (r.tokens, int(r.damage)) for r in QUERIES["p5_classify_documents"](spark, str(tmp_path)).collect()}
    assert found == {("en", "damage"): (5, 26_000_000_000_000_001_005), ("en", "item"): (1, 0), ("de", "damage"): (1, 7)}
