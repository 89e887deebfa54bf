"""Views that give the supplied tables the shape of the combat-reading tables.

All of them are narrow projections over one scan (integer arithmetic only), so filters and
column pruning reach the parquet reader.  ``SQL`` holds the same definitions for the
comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_time(df: DataFrame) -> DataFrame:
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return df.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")) - base)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings / detected hits from ``events``; one frame per hour, eight users per session."""
    e = _event_time(table(spark, sf_dir, "events"))
    i = F.col("event_id")
    return e.select(
        F.expr("user_id div 8").alias("session_id"),
        F.expr("cast(_us div 3600000000 as int)").alias("frame_index"),
        F.expr("_us div 1000").alias("timestamp_ms"),
        i.alias("ordinal"),
        ((F.floor(F.col("value") / 25) + 1) * 1000).cast("bigint").alias("parsed_value"),
        ((i * 7) % 50 + 50).cast("double").alias("_c"),
        ((i * 37) % 200).cast("double").alias("center_x"),
        ((i * 53) % 150).cast("double").alias("center_y"),
        F.col("event_type"),
    ).select(
        "session_id", "frame_index", "timestamp_ms", "ordinal", "parsed_value",
        (F.col("_c") / 100).alias("confidence"), "center_x", "center_y", "event_type",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text readings: fifteen spelling shapes around the digits of the event id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr("user_id div 8").alias("session_id"),
        F.col("event_id").alias("ordinal"),
        F.expr(
            """case event_id % 15
            when 0 then concat(event_id % 1000, 'K')
            when 1 then concat(event_id % 10, ',', lpad(cast(event_id % 1000 as string), 3, '0'))
            when 2 then concat(event_id % 100, ',', event_id % 10, 'K')
            when 3 then concat(event_id % 100, '.', event_id % 1000, 'm')
            when 4 then concat(event_id % 500, ' Gold')
            when 5 then 'Helm'
            when 6 then '??'
            when 7 then ''
            when 8 then concat(' ', event_id % 100000, ' ')
            when 9 then concat(event_id % 10, ',', event_id % 100)
            when 10 then concat('S', event_id % 100, 'O')
            when 11 then concat(event_id % 10, ',', lpad(cast(event_id % 1000 as string), 3, '0'), 'K')
            when 12 then concat('0', event_id % 100, 'b')
            when 13 then cast(event_id % 10 as string)
            else concat(event_id % 7, '.', event_id % 11, '.', event_id % 13, 'K') end"""
        ).alias("text"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: every third hit, slightly moved in frame and position."""
    h = hits(spark, sf_dir).filter(F.col("ordinal") % 3 == 0)
    j = F.col("ordinal") % 5 - 2
    return h.select(
        "session_id",
        (F.col("frame_index") + j).cast("int").alias("frame"),
        F.col("parsed_value").alias("value"),
        (F.col("center_x") + j * 10).alias("x"),
        (F.col("center_y") - j * 5).alias("y"),
        "ordinal",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.select(
        "session_id", F.col("frame_index").alias("frame"), F.col("parsed_value").alias("value"),
        "center_x", "center_y", "confidence", "ordinal",
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("xp_orb", "gold_drop", "item_drop", "death_animation", "sparkle")]), (F.col("ordinal") % 5 + 1).cast("int"))
    return h.filter(F.col("event_type") == "purchase").select(
        "session_id", kind.alias("cue_type"), F.col("frame_index").alias("frame"), "timestamp_ms", "center_x", "center_y", "ordinal"
    )


def damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.filter(F.col("event_type") != "purchase").select(
        "session_id", F.col("frame_index").alias("frame"), "timestamp_ms", F.col("parsed_value").alias("value"), "center_x", "center_y", "ordinal"
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token boxes from ``lineitem``: session = 64 orders, frame = order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.expr("l_orderkey div 64").alias("session_id"),
        F.expr("cast(l_orderkey % 2147483647 as int)").alias("frame_index"),
        F.expr("(l_orderkey * 8 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint)").alias("ordinal"),
        F.expr("cast(l_partkey * 7 % 300 as int)").alias("left"),
        F.expr("cast(l_suppkey * 11 % 120 as int)").alias("top"),
        F.expr("cast(20 + l_partkey % 90 as int)").alias("width"),
        F.expr("cast(12 + l_suppkey % 60 as int)").alias("height"),
        F.expr("cast(l_quantity * 40 as int)").alias("pixel_count"),
        F.expr("cast(1 + l_linenumber % 7 as int)").alias("member_count"),
    ).select(
        "*",
        F.expr("left + width - 1").alias("right"),
        F.expr("top + height - 1").alias("bottom"),
    )


def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("session_id"),
        F.col("l_orderkey").alias("frame_index"),
        F.concat("l_returnflag", "l_linestatus").alias("stage"),
        (F.col("l_quantity") + F.col("l_discount") * 100).alias("elapsed_ms"),
    )


def memory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.expr("o_custkey div 16").alias("session_id"),
        F.col("o_orderkey").alias("frame_index"),
        F.col("o_orderpriority").alias("stage"),
        F.floor(F.col("o_totalprice") / 1000).alias("rss_mb"),
    )


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.expr("vec_id div 50").alias("session_id"),
        F.col("vec_id").cast("int").alias("frame_index"),
        F.expr("transform(embedding, v -> cast(v as double) * 100)").alias("thumb"),
    )


def frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame detection log rows from ``orders``."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.expr("o_custkey div 16").alias("session_id"),
        F.col("o_orderkey").alias("frame_index"),
        F.expr("cast(o_orderkey % 7 as int)").alias("candidates"),
        F.expr("cast(o_orderkey % 7 % 3 as int)").alias("hits"),
        F.expr("cast(o_orderkey % 7 - o_orderkey % 7 % 3 as int)").alias("rejected"),
        F.expr("cast(floor(o_totalprice) as bigint)").alias("damage"),
        F.expr("o_custkey % 100 / 100.0D").alias("max_confidence"),
        F.expr("cast(o_custkey % 40 as double) + 5").alias("processing_time_ms"),
    )


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested log rows: each rejected candidate carries a list of reasons (from ``events.props``)."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int")["k"]
    return e.select(
        F.expr("user_id div 8").alias("session_id"),
        F.col("event_id").alias("frame_index"),
        k.alias("k"),
        F.col("event_type"),
    ).select(
        "session_id",
        "frame_index",
        F.expr(
            """array(
              named_struct('text', event_type, 'confidence', k / 100.0D, 'reasons',
                filter(array(case when k < 30 then 'low_confidence' end, case when k % 2 = 0 then 'implausible' end,
                             case when event_type = 'error' then 'parse_failed' end), r -> r is not null)))"""
        ).alias("rejected"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier candidates: ``labels`` joined to ``documents`` (the label is the quality flag)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("ordinal"),
        (F.col("n_chars") % 97 / 8.0).alias("line_score"),
        (F.col("n_chars") % 6 + 1).cast("int").alias("member_count"),
        (F.col("n_chars") % 200 + 20).cast("int").alias("width"),
        (F.col("n_chars") % 50 + 12).cast("int").alias("height"),
        (F.col("n_chars") % 1500).cast("int").alias("pixel_count"),
        F.expr("concat(n_chars % 1000, case doc_id % 4 when 0 then 'K' when 1 then '' when 2 then '.5M' else 'x' end)").alias("raw_text"),
        F.col("quality").alias("label"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured pixels from ``lineitem``: frames of 60 x 40, colours from keys and quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.expr("cast(l_orderkey div 200 as int)").alias("frame_index"),
        F.expr("cast(l_partkey % 60 as int)").alias("x"),
        F.expr("cast(l_suppkey % 40 as int)").alias("y"),
        F.expr("cast(l_partkey * 13 % 256 as int)").alias("r"),
        F.expr("cast(l_suppkey * 29 % 256 as int)").alias("g"),
        F.expr("cast(l_quantity * 5 as int)").alias("b"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation counts per scenario, before ('F') and after ('O'), from ``orders``."""
    o = table(spark, sf_dir, "orders")
    return (
        o.filter(F.col("o_orderstatus").isin("F", "O"))
        .groupBy(F.expr("o_custkey div 8").alias("session_id"), F.col("o_orderstatus").alias("run"))
        .agg(
            F.count_if(F.col("o_orderkey") % 10 < 8).alias("tp"),
            F.count_if(F.col("o_orderkey") % 10 == 8).alias("fp"),
            F.count_if(F.col("o_orderkey") % 10 == 9).alias("fn"),
            F.round(F.avg(F.col("o_orderkey") % 40), 4).alias("fps"),
        )
    )


_T0 = "TIMESTAMP '2024-01-01'"
SQL: dict[str, str] = {
    "hits": f"""SELECT user_id // 8 AS session_id,
        CAST((epoch_us(ts) - epoch_us({_T0})) // 3600000000 AS INTEGER) AS frame_index,
        (epoch_us(ts) - epoch_us({_T0})) // 1000 AS timestamp_ms, event_id AS ordinal,
        CAST((floor(value / 25) + 1) * 1000 AS BIGINT) AS parsed_value,
        CAST((event_id * 7) % 50 + 50 AS DOUBLE) / 100 AS confidence,
        CAST((event_id * 37) % 200 AS DOUBLE) AS center_x, CAST((event_id * 53) % 150 AS DOUBLE) AS center_y, event_type
        FROM events""",
    "texts": """SELECT user_id // 8 AS session_id, event_id AS ordinal, CASE event_id % 15
        WHEN 0 THEN concat(event_id % 1000, 'K')
        WHEN 1 THEN concat(event_id % 10, ',', lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'))
        WHEN 2 THEN concat(event_id % 100, ',', event_id % 10, 'K')
        WHEN 3 THEN concat(event_id % 100, '.', event_id % 1000, 'm')
        WHEN 4 THEN concat(event_id % 500, ' Gold')
        WHEN 5 THEN 'Helm' WHEN 6 THEN '??' WHEN 7 THEN ''
        WHEN 8 THEN concat(' ', event_id % 100000, ' ')
        WHEN 9 THEN concat(event_id % 10, ',', event_id % 100)
        WHEN 10 THEN concat('S', event_id % 100, 'O')
        WHEN 11 THEN concat(event_id % 10, ',', lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'), 'K')
        WHEN 12 THEN concat('0', event_id % 100, 'b')
        WHEN 13 THEN CAST(event_id % 10 AS VARCHAR)
        ELSE concat(event_id % 7, '.', event_id % 11, '.', event_id % 13, 'K') END AS text FROM events""",
    "truth": """SELECT session_id, CAST(frame_index + (ordinal % 5 - 2) AS INTEGER) AS frame, parsed_value AS value,
        center_x + (ordinal % 5 - 2) * 10 AS x, center_y - (ordinal % 5 - 2) * 5 AS y, ordinal
        FROM hits WHERE ordinal % 3 = 0""",
    "detections": """SELECT session_id, frame_index AS frame, parsed_value AS value, center_x, center_y, confidence, ordinal FROM hits""",
    "cues": """SELECT session_id, ['xp_orb', 'gold_drop', 'item_drop', 'death_animation', 'sparkle'][ordinal % 5 + 1] AS cue_type,
        frame_index AS frame, timestamp_ms, center_x, center_y, ordinal FROM hits WHERE event_type = 'purchase'""",
    "damage": """SELECT session_id, frame_index AS frame, timestamp_ms, parsed_value AS value, center_x, center_y, ordinal
        FROM hits WHERE event_type <> 'purchase'""",
    "boxes": """SELECT *, "left" + width - 1 AS "right", top + height - 1 AS bottom FROM (
        SELECT l_orderkey // 64 AS session_id, CAST(l_orderkey AS INTEGER) AS frame_index, (l_orderkey * 8 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) AS ordinal,
        CAST(l_partkey * 7 % 300 AS INTEGER) AS "left", CAST(l_suppkey * 11 % 120 AS INTEGER) AS top,
        CAST(20 + l_partkey % 90 AS INTEGER) AS width, CAST(12 + l_suppkey % 60 AS INTEGER) AS height,
        CAST(l_quantity * 40 AS INTEGER) AS pixel_count, CAST(1 + l_linenumber % 7 AS INTEGER) AS member_count FROM lineitem)""",
    "stage_timings": """SELECT l_suppkey AS session_id, l_orderkey AS frame_index, l_returnflag || l_linestatus AS stage,
        l_quantity + l_discount * 100 AS elapsed_ms FROM lineitem""",
    "memory_samples": """SELECT o_custkey // 16 AS session_id, o_orderkey AS frame_index, o_orderpriority AS stage,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS rss_mb FROM orders""",
    "thumbs": """SELECT vec_id // 50 AS session_id, CAST(vec_id AS INTEGER) AS frame_index,
        list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 100) AS thumb FROM embeddings""",
    "frame_log": """SELECT o_custkey // 16 AS session_id, o_orderkey AS frame_index, CAST(o_orderkey % 7 AS INTEGER) AS candidates,
        CAST(o_orderkey % 7 % 3 AS INTEGER) AS hits, CAST(o_orderkey % 7 - o_orderkey % 7 % 3 AS INTEGER) AS rejected,
        CAST(floor(o_totalprice) AS BIGINT) AS damage, o_custkey % 100 / 100.0::DOUBLE AS max_confidence,
        CAST(o_custkey % 40 AS DOUBLE) + 5 AS processing_time_ms FROM orders""",
    "rejections": """SELECT session_id, frame_index, k, event_type, list_filter([CASE WHEN k < 30 THEN 'low_confidence' END,
        CASE WHEN k % 2 = 0 THEN 'implausible' END, CASE WHEN event_type = 'error' THEN 'parse_failed' END], lambda r: r IS NOT NULL) AS reasons
        FROM (SELECT user_id // 8 AS session_id, event_id AS frame_index, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events)""",
    "samples": """SELECT d.doc_id AS ordinal, (n_chars % 97) / 8.0::DOUBLE AS line_score, CAST(n_chars % 6 + 1 AS INTEGER) AS member_count,
        CAST(n_chars % 200 + 20 AS INTEGER) AS width, CAST(n_chars % 50 + 12 AS INTEGER) AS height,
        CAST(n_chars % 1500 AS INTEGER) AS pixel_count,
        concat(n_chars % 1000, CASE d.doc_id % 4 WHEN 0 THEN 'K' WHEN 1 THEN '' WHEN 2 THEN '.5M' ELSE 'x' END) AS raw_text,
        quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "pixels": """SELECT CAST(l_orderkey // 200 AS INTEGER) AS frame_index, CAST(l_partkey % 60 AS INTEGER) AS x,
        CAST(l_suppkey % 40 AS INTEGER) AS y, CAST(l_partkey * 13 % 256 AS INTEGER) AS r,
        CAST(l_suppkey * 29 % 256 AS INTEGER) AS g, CAST(l_quantity * 5 AS INTEGER) AS b FROM lineitem""",
    "runs": """SELECT o_custkey // 8 AS session_id, o_orderstatus AS run, count(*) FILTER (o_orderkey % 10 < 8) AS tp,
        count(*) FILTER (o_orderkey % 10 = 8) AS fp, count(*) FILTER (o_orderkey % 10 = 9) AS fn,
        round(avg(o_orderkey % 40), 4) AS fps FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""",
}
_NEEDS = {"truth": ["hits"], "detections": ["hits"], "cues": ["hits"], "damage": ["hits"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the definitions of the named views (and what they build on).

    A view whose name equals a column is fine: names live in different places.
    """
    ordered: list[str] = []
    for n in names:
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in ordered:
                ordered.append(dep)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in ordered)
    body = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(lead):
            return f"{lead}{head}, {body[len(lead):]}"
    return f"WITH {head} {body}"
