"""Best-fit packing of documents into token sequences by hierarchical residual packing.

Each task tokenises its rows and packs the pieces best-fit decreasing into sequences of ``CAPACITY`` tokens.
Sequences that are nearly full are final.  The others become items themselves: groups of tasks meet in a tree,
``FAN_IN`` at a time, and each round packs the underfull sequences of a group best-fit once more.  Above
``AT_ONCE`` underfull sequences a group is not merged further, so no task ever holds an unbounded number; the rounds end
when one group is left or a round no longer saves anything.

NULL and empty texts are the end token alone.  Rows are packed as they come: repeated rows and NULL ids are
documents of their own.  Texts above the capacity are cut into full pieces and a rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import blocks, lower_ascii, table, texts_of
from emberlog.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: A sequence with at most this many free tokens is final.
SLACK = 8
FAN_IN = 8
#: Items that one task packs together.
AT_ONCE = 200_000
#: Entries of each of the two generations of the word cache, and bytes of text whose words are looked up together.
CACHE, BYTES = 250_000, 1 << 22
#: Signs that may close a word.
SIGNS = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
IS_SIGN = np.isin(np.arange(256), list(SIGNS))
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint"


class WordIds:
    """Token ids of whole columns of texts, each distinct word looked up once in a bounded cache.

    White space always ends a token here and case is folded, so a text's ids are those of its words in a row.  Runs of
    letters, and a sign after them, are words of their own to the tokenizer and end in a token that says so.
    """

    def __init__(self, path: str, size: int = CACHE):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode
        self.size, self.new, self.old = size, {}, {}
        self.is_end = np.zeros(tokenizer.get_vocab_size(), bool)
        self.is_end[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: pa.Array) -> Iterator[memoryview]:
        """The ids of each text as little-endian bytes; a NULL has none."""
        data, at = texts_of(texts)
        special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)  # may name a token whose case counts
        for lo, hi in blocks(at[1:] - at[:-1], BYTES):
            ids, bounds = self._of_words(lower_ascii(data[at[lo] : at[hi]]), at[lo : hi + 1] - at[lo])
            view = memoryview(ids.tobytes())
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), lo):
                yield memoryview(self._ids(texts[i].as_py())) if special[i] else view[4 * a : 4 * b]

    def _of_words(self, low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, and where each text's begin."""
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = bounds[:-1][bounds[:-1] < len(word)]
        first[inner] = word[inner]
        first[self._tails(low, word)] = True
        letters = np.concatenate([[0], np.cumsum(word)])
        starts = np.flatnonzero(first)
        offsets = np.concatenate([letters[starts], letters[-1:]]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[word]))])
        words = words.dictionary_encode()
        which = words.indices.to_numpy()
        known = self._look_up(words.dictionary.to_pylist())
        sizes = np.array([len(k) for k in known], np.int64) // 4
        flat = np.frombuffer(b"".join(known) or bytes(4), "<u4")
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        ids = flat[np.repeat(shift, counts) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, bounds)]

    @staticmethod
    def _tails(low: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where signs begin that close a word after a plain letter or digit: they are a word of their own to the tokenizer."""
        last = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) if len(word) else np.zeros(0, np.int64)
        solid = np.where(IS_SIGN[low] | ~word, 0, np.arange(1, len(low) + 1, dtype=np.int32))
        tail = np.maximum.accumulate(solid)[last] if len(last) else last
        tail = tail[(tail <= last) & (tail > 0)]
        return tail[word[tail - 1] & (low[tail - 1] < 128)]

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        missing = []
        for word in words:
            if word not in new:
                if word in old:
                    new[word] = old[word]
                else:
                    missing.append(word)
        if missing:
            self._learn(missing)
        out = [new[w] for w in words]
        if len(new) > self.size:
            self.old, self.new = new, {}
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Tokenises words not seen lately.  Words of letters alone, with closing signs or not, go together: signs in a row are a word too."""
        cores = {w: w if w.isalpha() else w.rstrip(SIGNS) for w in words}
        plain = [c for c in set(cores.values()) if c.isalpha() or (not c.isascii() and c.decode().isalpha() and c.decode().lower().isalpha())]
        found = dict(zip(plain, self._together(plain), strict=True))
        tails = {b"": b""}
        for w, core in cores.items():
            ids = found.get(core)
            if ids is None:
                self.new[w] = self._ids(w.decode())
                continue
            tail = w[len(core) :]
            if tail not in tails:
                tails[tail] = self._ids(tail.decode())
            self.new[w] = ids + tails[tail]

    def _together(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self.encode(" ".join(w.decode() for w in words), add_special_tokens=False).ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
        if len(cuts) != len(words):  # some letter falls apart when folded
            return [self._ids(w.decode()) for w in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]


_WORDS: dict[str, WordIds] = {}


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin.

    The bins of each free size are a list; a bit mask of the free sizes in use finds the tightest one.
    """
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = in_use >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                in_use ^= 1 << gap
        else:
            gap, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if gap > n:
            by_gap[gap - n].append(b)
            in_use |= 1 << (gap - n)
    return bins, offsets, np.array(fills, np.int64)


def _tokenise_and_pack(path: str, capacity: int, end_id: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORDS:
            _WORDS[path] = WordIds(path)
        ids_of = _WORDS[path]
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        cols: list[list] = [[] for _ in range(5)]

        def packed() -> pa.RecordBatch:
            nonlocal first
            bins, offsets, fills = best_fit(np.array(cols[3], np.int64), capacity)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(bins + first), pa.array(offsets)], [f.split()[0] for f in PIECES.split(", ")])
            first += len(fills)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1)), strict=True):
                n = len(ids) // 4 + 1
                for piece, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    if at + size == n:
                        crc = zlib.crc32(end, crc)
                    for c, v in zip(cols, (doc, piece, at, size, crc), strict=True):
                        c.append(v)
                if len(cols[0]) >= at_once:
                    yield packed()
        if cols[0]:
            yield packed()

    return run


def _repack(capacity: int, at_once: int):
    """Bins of one group as items: the new bin of each and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            ids, fills = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(ids)
            ids, fills = ids[order], fills[order]
            bins, offsets, _ = best_fit(fills, capacity)
            # A new bin has the number of the bin placed at its start.
            at_start = np.zeros(bins.max() + 1, np.int64)
            at_start[bins[offsets == 0]] = ids[offsets == 0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, at_start[bins], offsets, fills)], ["bin", "into", "base", "fill"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= at_once:
                yield packed()
        if any(len(x) for x, _ in held):
            yield packed()

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, at_once: int = AT_ONCE) -> DataFrame:
    """One row per piece of ``docs (doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``path`` is the vocabulary file of a tokenizer that folds case and ends words at white space.
    """
    ready = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut_lineage(ready.mapInArrow(_tokenise_and_pack(path, capacity, end_id, at_once), PIECES))
    # Which bin each underfull bin went into so far, and at what place; `last` is the bin it is in now.
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    open_bins = cut_lineage(fills.filter(F.col("fill") < capacity - slack))
    moves = None
    count = open_bins.count()
    groups = pieces.select(F.shiftright("bin", 40)).distinct().count()
    while count > 1:
        groups = max(1, groups // FAN_IN, count // at_once)
        dealt = open_bins.select("bin", "fill").repartition(groups, "bin") if groups > 1 else open_bins.select("bin", "fill").coalesce(1)
        moved = cut_lineage(dealt.mapInArrow(_repack(capacity, at_once), "bin bigint, into bigint, base bigint, fill bigint"))
        step = moved.filter(F.col("bin") != F.col("into")).select("bin", "into", "base")
        if moves is None:
            moves = cut_lineage(step)
        else:
            further = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("base").alias("more"))
            earlier = moves.join(further, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
            moves = cut_lineage(earlier.unionByName(step))
        fills = moved.groupBy(F.col("into").alias("bin")).agg(F.sum("fill").alias("fill"))
        open_bins = cut_lineage(fills.filter(F.col("fill") < capacity - slack))
        before, count = count, open_bins.count()
        if groups == 1 or count > 0.99 * before and groups <= count // at_once + 1:
            break
    if moves is None:
        return pieces.withColumnRenamed("bin", "sequence_id")
    found = pieces.join(moves, "bin", "left")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
