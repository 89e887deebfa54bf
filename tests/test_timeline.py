"""Bin-wise windows against plain pandas, with bins far smaller than the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import stats as st, timeline as tl


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 1500
    pdf = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], n), "t": rng.integers(0, 4000, n), "v": rng.integers(1, 100, n)})
    pdf = pdf.drop_duplicates(["k", "t"]).sort_values(["k", "t"], ignore_index=True)
    pdf["w"] = pdf["v"].where(pdf["v"] % 7 == 0)
    return pdf


@pytest.fixture(scope="module")
def table(spark, rows):
    data = [(int(a), int(b), int(c), None if d != d else int(d)) for a, b, c, d in rows[["k", "t", "v", "w"]].itertuples(index=False)]
    return spark.createDataFrame(data, "k int, t int, v bigint, w bigint")


def sorted_pdf(df):
    return df.toPandas().sort_values(["k", "t"], ignore_index=True)


def test_running(table, rows):
    out = sorted_pdf(tl.running(table, ["k"], "t", sums={"s": "v"}, maxes={"m": "v"}, lasts={"l": "w"}, width=37))
    g = rows.groupby("k")
    assert (out["s"] == g["v"].cumsum()).all() and (out["m"] == g["v"].cummax()).all()
    assert out["l"].fillna(-1).tolist() == g["w"].ffill().fillna(-1).tolist()


def test_previous_row_and_positions(table, rows):
    out = sorted_pdf(tl.previous_row(table, ["k"], "t", ["v"], width=11))
    assert out["prev_v"].fillna(-1).tolist() == rows.groupby("k")["v"].shift().fillna(-1).tolist()
    pos = sorted_pdf(tl.positions(table, ["k"], "t", width=11))
    assert pos["pos"].tolist() == rows.groupby("k").cumcount().tolist()


def test_trailing(table, rows):
    out = sorted_pdf(tl.trailing(table, ["k"], "t", 50, {"s": F.sum("v")}, width=51))
    want = [int(rows[(rows.k == k) & (rows.t >= t - 50) & (rows.t <= t)]["v"].sum()) for k, t in rows[["k", "t"]].itertuples(index=False)]
    assert out["s"].tolist() == want


@pytest.mark.parametrize("width", [5, 64, 100_000])
def test_islands(table, rows, width):
    out = sorted_pdf(tl.islands(table, ["k"], "t", 3, width=width))
    want = []
    for _, g in rows.groupby("k"):
        start = prev = None
        for t in g["t"]:
            if prev is None or t - prev > 3:
                start = t
            prev = t
            want.append(start)
    assert out["island_start"].tolist() == want


@pytest.mark.parametrize("resolution", [1, 16384])
def test_quantiles(table, rows, resolution):
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = tl.quantiles(table, ["k"], "v", probs, resolution=resolution).toPandas().set_index("k")
    for k, g in rows.groupby("k"):
        for name, p in probs.items():
            assert out.loc[k, name] == pytest.approx(np.quantile(g["v"], p))


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(1, 5.0)] * 4 + [(2, float(i)) for i in range(1, 11)], "k int, v double")
    out = {r.k: r.p95 for r in tl.quantiles(df, ["k"], "v", {"p95": 0.95}).collect()}
    assert out == {1: 5.0, 2: pytest.approx(9.55)}


def test_dense_buckets(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 4)], "k int, last bigint")
    got = {(r.k, r.b) for r in tl.dense_buckets(df, ["k"], "last", "b", chunk=4).collect()}
    assert got == {(1, 0)} | {(2, i) for i in range(11)} | {(3, i) for i in range(5)}


def test_dps_timeline_fills_gaps(spark):
    df = spark.createDataFrame([(1, 1, 200, 1000), (1, 2, 900, 2000), (1, 3, 1000, 3000), (1, 4, 1800, 4000), (2, 3100, None, 7)], "session_id int, frame_index int, timestamp_ms bigint, parsed_value bigint")
    out = {(r.session_id, r.start_ms): (r.damage, r.hit_count) for r in st.dps_timeline(df).collect()}
    assert out == {(1, 0): (3000, 2), (1, 1000): (7000, 2), (2, 0): (0, 0), (2, 1000): (0, 0), (2, 2000): (0, 0), (2, 3000): (7, 1)}


def test_rolling_window_is_closed(spark):
    df = spark.createDataFrame([(1, 0, 0, 1000, 1), (1, 1, 1000, 2000, 2), (1, 2, 5000, 10, 3), (1, 3, 10001, 500, 4)], "session_id int, frame_index int, timestamp_ms bigint, parsed_value bigint, ordinal bigint")
    out = {r.timestamp_ms: r.rolling_damage for r in st.rolling_damage(df).collect()}
    assert out == {0: 1000, 1000: 3000, 5000: 3010, 10001: 500}


def test_quantiles_of_negative_values(spark):
    values = [-5.0, -0.5, 0.0, 0.25, 3.0, 1e6]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    row = tl.quantiles(df, ["k"], "v", {"p20": 0.2, "p50": 0.5}).first()
    assert (row.p20, row.p50) == (pytest.approx(np.quantile(values, 0.2)), pytest.approx(np.quantile(values, 0.5)))
