"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import hamming_minhash as near
from emberlog.llm import poly_dedup as exact
from emberlog.llm.common import Polynomial
from emberlog.llm.components import components

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_polynomials_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, np.uint8)
    poly = Polynomial(5000)
    whole = poly.ranges(data, np.array([0]), np.array([5000]), at_once=700)
    cuts = np.array([0, 13, 13, 1000, 4999, 5000])
    parts = poly.ranges(data, cuts[:-1], cuts[1:])
    for k, p in enumerate(poly.primes):
        acc = 0
        for h, n in zip(parts[k], np.diff(cuts), strict=True):
            acc = (acc * pow(poly.BASES[k], int(n), p) + int(h)) % p
        assert acc == int(whole[k][0])


@pytest.mark.parametrize("primes", [Polynomial.PRIMES, (3, 5)], ids=["usual", "colliding"])
def test_exact_classes(spark, primes):
    random.seed(5)
    texts = ["", None, "AbC", "abc", "abd", "ABCDEFGHIJ", "abcdefghij", "abcdefghix", "É" * 9, "é" * 9, "a" * 41]
    rows = [(i, random.choice(texts)) for i in range(80)] + [(3, "abc"), (3, "abc")]
    found = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk=4, primes=primes).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    expected = [(i, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == sorted(expected)
    assert sorted(r["doc_id"] for r in found if r["kept"]) == sorted(max(g) for g in groups.values())


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize("k", [2, 5])
def test_shingle_sets(k):
    texts = ["", None, " \t", "One", "one two", "a b c d e", "a b a b a b", "x" * 5000 + " b " + "X" * 5000 + " b", "é è\x0bê\x1cë ü ö a b", " lead trail "]
    found = list(near.shingle_sets(pa.array(texts), k))
    assert [len(f) for f in found] == [len(shingles(t, k)) for t in texts]
    assert np.array_equal(found[3], list(near.shingle_sets(pa.array(["ONE"]), k))[0])


@pytest.mark.parametrize("large", [near.LARGE, 2])
def test_near_components(spark, monkeypatch, large):
    """Also with components that are compared in blocks, of very few members and other nodes."""
    monkeypatch.setattr(near, "LARGE", large)
    if large == 2:
        monkeypatch.setattr(near, "HOSTS", 2)
        monkeypatch.setattr(near, "GUESTS", 2)
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = random.choices(vocabulary, k=random.randint(8, 300))
        rows.append(" ".join(base))
        for _ in range(random.randint(0, 14)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(copy) // 16))):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", None, "single", "single", "w1 w2", "w2 w1"]
    rows = list(enumerate(rows))
    found = {r["doc_id"]: r for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in found.items()} == {i: root(i) for i in sets}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_signatures_within_the_distance_meet():
    """Any pattern of up to ``2 * CHUNKS - 1`` differing symbols leaves a common bucket."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        sig = rng.integers(0, 1 << 16, near.LENGTH).astype("<u2")
        other = sig.copy()
        places = rng.choice(near.LENGTH, (near.ERRORS + 1) * near.CHUNKS - 1, replace=False)
        other[places] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([sig.tobytes(), other.tobytes()])], ["cid", "sig"])
        buckets = list(near._buckets(iter([batch])))[0]
        assert any(r is not None for r in buckets.column(2).to_pylist())


def test_components_of_long_chains(spark, monkeypatch):
    import emberlog.llm.components as module

    monkeypatch.setattr(module, "AT_ONCE", 10)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 5), (9, 9)]
    random.seed(2)
    random.shuffle(links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 5, 9: 5, 5: 5}


def test_blocks_find_links():
    """A block's members and guests against guests: every link to a guest, one to a member wherever there is any."""
    rng = np.random.default_rng(5)
    base = rng.choice(10_000, 60, replace=False)
    vary = lambda n: np.sort(np.concatenate([base[n:], 20_000 + rng.choice(10_000, n, replace=False)])).astype(np.int64)
    hosts = {i: vary(int(rng.integers(0, 8))) for i in range(20)}
    guests = {100 + i: vary(int(rng.integers(0, 16))) for i in range(40)}
    table = lambda d, a, b: pa.table({a: pa.array(list(d)), b: pa.array(list(d.values()), pa.list_(pa.int64()))})
    rows = table({**hosts, **guests}, "cid", "shingles").append_column("member", pa.array([True] * 20 + [False] * 40))
    found = near._block_links(80)(rows, table(guests, "guest", "own")).to_pydict()
    similar = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    pairs = list(zip(found["a"], found["b"], strict=True))
    to_members = [a for a, b in pairs if b in hosts]
    assert sorted(to_members) == [g for g, x in guests.items() if any(similar(x, h) for h in hosts.values())] and 0 < len(to_members) < 40
    assert {p for p in pairs if p[1] in guests} == {(a, b) for a in guests for b in guests if a != b and similar(guests[a], guests[b])}
    assert all(similar(guests[a], {**hosts, **guests}[b]) for a, b in pairs)
