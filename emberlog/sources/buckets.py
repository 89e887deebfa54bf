"""Tables of hashed buckets with a manifest, for results that are replaced session by session.

A row lies in the bucket of its key's hash, so the number of files follows ``BUCKETS``, not the sessions.  Replacing sessions
writes the touched buckets anew, below a version of their own, and then one small manifest that says which version of each bucket counts.
Readers see the old table or the new one, never a mixture; a batch that is repeated, or fails half way, does no harm.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """The newest version of the table and, for each bucket (at most ``BUCKETS``), the version that holds it."""
    try:
        found = spark.read.schema("bucket int, held int, version int").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, {}
    newest = found.agg(F.max("version")).first()[0]
    if newest is None:
        return -1, {}
    return newest, {r["bucket"]: r["held"] for r in found.filter(F.col("version") == newest).select("bucket", "held").collect()}


def load_rows(spark: SparkSession, folder: str, schema, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a table, or of some of its buckets; no rows if there is no table yet."""
    held = _manifest(spark, folder)[1]
    paths = [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched_buckets(rows: DataFrame, key: str) -> set[int]:
    return {r[0] for r in rows.select(bucket_of(key)).distinct().collect()}


def replace_rows(rows: DataFrame, folder: str, key: str) -> None:
    """Replaces all rows of the keys in ``rows``; only their buckets are read and written."""
    spark = rows.sparkSession
    newest, held = _manifest(spark, folder)
    touched = touched_buckets(rows, key)
    if not touched:
        return
    mine = rows.select(F.col(key).alias("_key")).distinct()
    old = load_rows(spark, folder, rows.schema, touched)
    kept = old.join(mine, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    version = newest + 1
    placed = kept.unionByName(rows).withColumn("bucket", bucket_of(key))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={version}")
    entries = [(b, version if b in touched else held[b]) for b in sorted(touched | held.keys())]
    spark.createDataFrame(entries, "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
