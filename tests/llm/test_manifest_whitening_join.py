"""Merkle manifest, whitening and n-gram join against plain versions of their own."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import bitmap_manifest as man
from emberlog.llm import feast_whitening as white
from emberlog.llm import vertical_jaccard as join
from tests.llm.test_dedup import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(i, text, lang, source, n):
    values = [i, source, lang, n, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root over ``nodes`` and the links (before, after) of each."""
    links, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            links[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes, at = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], links


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for s in order:
        rows_here = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (rows_here, *climb([leaf(*r) for r in rows_here]))
    root, above = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, above, strict=True):
        for r, links in zip(trees[s][0], trees[s][2], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r[0], r[1].translate(lower) if tampered and r[1] is not None else r[1], *r[2:])
            for before, after in links + top:
                now = digest(before + now + after)
            out.append((r[0], leaf(*r), trees[s][1], root, digest("".join(b + a for b, a in links + top)), now, now == root))
    return out


def found_manifest(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in man.op12_bitmap_rank_manifest(spark, str(tmp_path)).collect()]


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("size", [1, 16, 17, 700])
def test_manifest_of_sparse_ids(spark, tmp_path, size):
    r = random.Random(size)
    ids = r.sample([*range(-200, 400), *[r.randrange(-(1 << 63), 1 << 63) for _ in range(400)], -(1 << 63), (1 << 63) - 1], size)
    rows = [(i, r.choice(["Some TEXT", "", None, "é " * 50]), r.choice(["en", None]), r.choice(["b", "a", None, "", "é"]) if size > 1 else "a", r.choice([1, None])) for i in ids]
    assert sorted(found_manifest(spark, rows, tmp_path), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_repeated_and_missing_ids(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([None, None, 5, 5, 6, 63, 64, 70_000, -1]), f"Text {r.randrange(12)}", None, r.choice(["a", "b"]), 1) for _ in range(400)]
    assert sorted(found_manifest(spark, rows, tmp_path), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_several_blocks_and_many_sources(spark, tmp_path, monkeypatch):
    rows = [(i, f"T{i}", "en", "hot" if i % 3 else f"s{i}", i) for i in range(9000)]
    assert sorted(found_manifest(spark, rows, tmp_path), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_paths_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", 1) for i in range(200)], SCHEMA)
    for r in man.manifest(docs, with_paths=True).collect():
        at = r["leaf"]
        for link in r["path"]:
            at = digest(link["before"] + at + link["after"])
        assert at == r["root"] == r["folded"]


# --- whitening -----------------------------------------------------------------------------


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, float))
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    v = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, (x - mean) @ u / np.sqrt(e), e / np.trace(v), [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(axis=0), strict=True)) for row in x]


@pytest.mark.parametrize("shape", ["decaying", "clustered", "alike"])
def test_whitening_against_eigenvectors(spark, shape):
    rng = np.random.default_rng(5)
    d = 40
    scale = {"decaying": 0.7 ** np.arange(d) + 0.02, "clustered": np.where(np.arange(d) < 3, 5.0, 0.3), "alike": np.full(d, 0.4)}[shape]
    vectors = rng.standard_normal((600, d)) * scale
    vectors = np.vstack([vectors, vectors[:50]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    n, want, explained, deviation = plain_whitening(vectors)
    rows = sorted(white.whiten(df).collect(), key=lambda r: (r["vec_id"], r["component"]))
    got = np.array([r["whitened"] for r in rows]).reshape(len(vectors), 16)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    assert rows[0]["n"] == n and rows[0]["identity_error"] < 1e-10
    assert np.allclose([r["explained"] for r in rows[:16]], explained, rtol=1e-10)
    assert [r["deviation"] for r in rows[::16]] == deviation


def test_whitening_of_few_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)
    found = white.whiten(line).collect()
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1.0)
    assert white.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    big = [[1e9 * (i % 7), 3e8 * i, 1e30 if i == 4 else 0.5] for i in range(9)]
    found = white.whiten(spark.createDataFrame(list(enumerate(big)), schema)).collect()
    assert len(found) % 9 == 0 and all(r["identity_error"] < 1e-4 for r in found)


def test_inertia_counts(spark):
    rng = np.random.default_rng(2)
    for a in (rng.standard_normal((30, 30)), np.diag(np.arange(30.0)), np.array([[0.0, 1.0], [1.0, 0.0]]), np.zeros((3, 3))):
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (-7.3, -0.5, 0.3, 1.1, 20.7):
            assert white.number_above(a, shift) == (values > shift).sum()


def test_gram_is_exact():
    rng = np.random.default_rng(4)
    for most in (50, 1 << 30, 1 << 41):
        z = rng.integers(-most, most, (700, 5))
        exact = z.astype(object)
        assert (white.exact_gram(z) == exact.T.dot(exact)).all()


# --- n-gram join ---------------------------------------------------------------------------


def plain_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), i), i)
    return sorted((i, len(sets[x]), least[root(x)]) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 2])
@pytest.mark.parametrize(("k", "percent"), [(4, 85), (2, 60)])
def test_gram_components(spark, monkeypatch, block, k, percent):
    """Also with blocks of very few nodes."""
    monkeypatch.setattr(join, "HOSTS", block)
    monkeypatch.setattr(join, "GUESTS", block)
    r = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = r.choices(words, k=r.randint(6, 150))
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " \t", "single", "Single", "w1 w2", "w2 w1", "w1 w2 w3 w4", texts[0].upper()]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x"))
    found = sorted(tuple(x) for x in join.gram_components(df, k, percent).collect())
    assert found == plain_components(rows, k, percent)
