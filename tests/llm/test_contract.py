"""Registered text queries: names, columns, SQL and odd tables."""

import pytest

from emberlog.llm import queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_site_template_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_semi_markov_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_license_rules": {
        "doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double",
    },
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_best_fit_packing": {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint",
    },
    "op10_rank_order_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_feast_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_bitmap_rank_manifest": {
        "doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean",
    },
    "op13_vertical_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.ORACLE)
def test_against_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name])
    assert ok and "TYPES" not in note, note


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    found = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert {k: found.get(k) for k in COLUMNS[name]} == COLUMNS[name]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in any column, empty and long texts, repeated rows, columns that clash with those of the operators."""
    folder = tmp_path_factory.mktemp("odd")
    clash = ", 'x' AS rid, 1 AS kept, 'y' AS row, 2 AS lang_pred, 3 AS keeper, 'z' AS _salt, 4 AS component_id, 5 AS bin, 6 AS host, 7 AS page, 8 AS found, 9 AS sketch"
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    clash_docs = clash + ", CAST(NULL AS STRING) AS source, CAST(NULL AS BIGINT) AS n_chars, 'z' AS grp, 'z' AS leaf, 3 AS gram, 4 AS cid"
    texts = ["NULL", "''", "' '", "'One two three four five six.'", "'one two three four five six.'", "'MIT License a@b.c 1.2.3.4'", f"'{long}'", f"'{long}'"]
    rows = [f"SELECT CAST({i if i % 4 else 'NULL'} AS BIGINT) AS doc_id, {t} AS text, CAST({'NULL' if i % 3 else repr('en')} AS STRING) AS lang{clash_docs}" for i, t in enumerate(texts)]
    spark.sql(" UNION ALL ".join([*rows, rows[3], rows[3]])).write.parquet(f"{folder}/documents.parquet")
    html = ["NULL", "''", "'<article><p>a &amp; b</article>'", "'<p>x'"]
    rows = [f"SELECT CAST({i if i % 4 else 'NULL'} AS BIGINT) AS page_id, {'NULL' if i == 1 else repr('http://h.example.org/a')} AS url, {t} AS html{clash}" for i, t in enumerate(html)]
    spark.sql(" UNION ALL ".join([*rows, rows[2]])).write.parquet(f"{folder}/pages.parquet")
    vectors = ["NULL", "array()", "array(1.0, 2.0)", "array(1.0, 2.0)", "array(1.5, NULL)", "array(0.5, double('NaN'))", "array(3.0, -1.0)", "array(0.0, double('Infinity'))", "array(7.0)", "array(-2.0, 0.25)"]
    rows = [f"SELECT CAST({i if i % 4 else 'NULL'} AS BIGINT) AS vec_id, CAST({v} AS ARRAY<DOUBLE>) AS embedding, CAST(NULL AS INT) AS label{clash}, 5 AS n, 6 AS component" for i, v in enumerate(vectors)]
    spark.sql(" UNION ALL ".join(rows)).write.parquet(f"{folder}/embeddings.parquet")
    items = ["SELECT CAST(NULL AS BIGINT) AS item_id, 'five six' AS text", "SELECT 1, CAST(NULL AS STRING)", "SELECT 2, ''", "SELECT 3, 'one two three'", "SELECT 3, 'one two three'"]
    spark.sql(" UNION ALL ".join(items)).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_odd_tables(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    expected = {"1": 5, "2": 10, "3": 5, "5": 10, "6": 10, "7": 10, "10": 10, "11": 8, "12": 10, "13": 10}.get(name[2:].split("_")[0])
    if expected is not None:
        assert len(rows) == expected
    if name.startswith("op6"):
        assert sum(r["kept"] for r in rows) == 5  # empty, blank, one to six, license, long
    if name.startswith("op4"):
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(3, None), (3, 3), (None, None), (None, 3)}
    if name.startswith("op8"):
        assert sum(r["length"] for r in rows if r["piece"] == 0 and r["doc_id"] in (1, 2)) == 2


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, odd))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert docs.count() > 0


def test_pipeline_of_nothing(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
