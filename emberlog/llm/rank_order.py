"""Language identification by rank-order profiles of character n-grams.

The most frequent n-grams (one to three characters, words padded by a blank) of each language are ranked by
frequency.  A document's own ranking is compared with each profile by the out-of-place distance: the sum over its
n-grams of the difference of ranks, the longest profile's length standing for an n-gram the profile lacks.  Counts cover all
training rows; only the profiles, at most ``PROFILE`` rows for each language, reach the driver.

A text that is NULL, empty or without a letter is ``und`` with score 0; so is every text when nothing was learned.
Ties between languages go to the alphabetically first, ties between n-grams to the smaller code.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import keyed, table
from emberlog.operators.timeline import top_k

#: n-grams kept for each language and each document.
PROFILE = 300
#: More distinct labels than this are an error in the label column, not languages.
MAX_LANGUAGES = 1000
#: The pipeline drops documents whose two best languages are closer than ``MIN_GAP`` (a share of the largest distance), and those whose score lies
#: ``FENCE`` interquartile ranges below the lower quartile of the documents labelled with a language, or below ``MIN_SCORE`` where none is.
MIN_GAP, FENCE, MIN_SCORE = 0.05, 2.0, 0.15
#: Fewer n-grams say less: the limit of the score shrinks in proportion below this number, that of the gap below a full profile, and such
#: documents set none.
SHORT = 100
UNKNOWN = "und"
BLANK = 32
LETTERS = regex.compile(r"\p{L}+")
#: Characters counted at once; longer texts are counted in parts and summed.
AT_ONCE = 1 << 19


def _codes(chars: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of blank-separated words; 21 bits for each character."""
    pairs = (chars[:-1] << 21) | chars[1:]
    triples = (pairs[:-1] << 21) | chars[2:]
    return np.concatenate([chars[chars != BLANK], pairs, triples[chars[1:-1] != BLANK]])


def _sum(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text, ascending, and how often each occurs."""
    words = " ".join(LETTERS.findall((text or "").lower()))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(chars) <= AT_ONCE:
        return np.unique(_codes(chars), return_counts=True)
    parts, lo = [], 0
    blanks = np.flatnonzero(chars == BLANK)
    while lo < len(chars) - 1:
        # Parts meet at a blank, which belongs to both; a word longer than a part is not cut.
        hi = int(blanks[min(max(np.searchsorted(blanks, lo + AT_ONCE, "right") - 1, np.searchsorted(blanks, lo, "right")), len(blanks) - 1)])
        parts.append(np.unique(_codes(chars[lo : hi + 1]), return_counts=True))
        lo = hi
    return _sum([c for c, _ in parts], [n for _, n in parts])


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, best first; the smaller code first among equals."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Ranked n-grams of each language of ``labelled (text, lang)``; rows without a language are not used."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size_of: dict[str, int] = defaultdict(int)

        def settle(lang: str) -> None:
            held[lang] = [_sum([c for c, _ in held[lang]], [n for _, n in held[lang]])]
            size_of[lang] = len(held[lang][0][0])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                found = gram_counts(text.as_py())
                if len(found[0]):
                    lang = lang.as_py()
                    held[lang].append(found)
                    size_of[lang] += len(found[0])
                    if size_of[lang] > 1 << 20:
                        settle(lang)
                        if size_of[lang] > 1 << 19:
                            yield _batch(lang, *held[lang][0])
                            held[lang], size_of[lang] = [], 0
        for lang in list(held):
            if held[lang]:
                settle(lang)
                yield _batch(lang, *held[lang][0])

    used = labelled.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    total = used.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = top_k(total, ["lang"], [F.desc("n"), F.col("code")], size).select("lang", "rank", "code")
    found: dict[str, list] = defaultdict(list)
    for row in best.limit(size * MAX_LANGUAGES + 1).collect():  # bounded by the profile size and the number of languages
        found[row["lang"]].append((row["rank"], row["code"]))
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages")
    return {lang: [code for _, code in sorted(rows)] for lang, rows in sorted(found.items())}


def _batch(lang: str, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])


def distances(grams: np.ndarray, lookup: list[tuple[str, np.ndarray, np.ndarray]], longest: int) -> list[int]:
    """Out-of-place distance of a document's ranked n-grams to each profile."""
    places = np.arange(len(grams))
    out = []
    for _, codes, ranks in lookup:
        at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
        out.append(int(np.where(codes[at] == grams, np.abs(ranks[at] - places), longest).sum()))
    return out


def predictor(learned: dict[str, list[int]], size: int = PROFILE):
    """Column function ``text -> struct<lang, score, gap, grams>``.

    The score is 1 less the share of the largest possible distance, the gap how much further the second language is (1 where there is one only).
    """
    longest = max((len(codes) for codes in learned.values()), default=0)

    @F.arrow_udf("struct<lang:string,score:double,gap:double,grams:int>")
    def predict(texts: pa.Array) -> pa.Array:
        lookup = []
        for lang, codes in learned.items():
            codes = np.array(codes, np.int64)
            order = np.argsort(codes)
            lookup.append((lang, codes[order], order))
        langs, scores, gaps, sizes = [], [], [], []
        for text in texts:
            grams = ranked(*gram_counts(text.as_py()), size)
            sizes.append(len(grams))
            if not len(grams) or not lookup:
                langs.append(UNKNOWN)
                scores.append(0.0)
                gaps.append(0.0)
                continue
            found = distances(grams, lookup, longest)
            best = int(np.argmin(found))
            langs.append(lookup[best][0])
            scores.append(1 - found[best] / (len(grams) * longest))
            gaps.append((sorted(found)[1] - found[best]) / (len(grams) * longest) if len(found) > 1 else 1.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gaps, pa.float64()), pa.array(sizes, pa.int32())], ["lang", "score", "gap", "grams"])

    return predict


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: the checksum of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``, learned from rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    learned = profiles(docs.filter(~held_out()), size)
    found = docs.select("doc_id", held_out().alias("held_out"), predictor(learned, size)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def limits(scored: DataFrame, size: int = PROFILE) -> dict[str, float]:
    """The least score of a document of each language, from ``scored (row, found)``: quartiles, so a few odd labelled rows move nothing."""
    found = scored.filter(F.col("row.lang").isNotNull() & (F.col("found.grams") >= min(SHORT, size))).select("found.lang", "found.score")
    quartiles = found.groupBy("lang").agg(F.percentile_approx("score", [0.25, 0.75]).alias("q"))
    return {r["lang"]: r["q"][0] - FENCE * (r["q"][1] - r["q"][0]) for r in quartiles.collect()}  # at most MAX_LANGUAGES rows


def in_known_language(docs: DataFrame, size: int = PROFILE, min_score: float = MIN_SCORE, min_gap: float = MIN_GAP) -> DataFrame:
    """The rows of ``docs`` in one of its own languages; those without letters, unlike their language, or as near to another go.

    A text in an unlearned language, of random letters, or of several languages in equal parts is far from the best language, or about as far from
    the second.  Where no row names a language there is nothing to compare with, and only rows without letters go.
    """
    learned = profiles(docs.filter(~held_out()).select("text", "lang"), size)
    if not learned:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    scored = keyed(docs, found=predictor(learned, size)(F.col("row.text")))
    limit = F.lit(min_score)
    if least := limits(scored, size):
        limit = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])[F.col("found.lang")], limit)
    share = lambda enough: F.least(F.lit(1.0), F.col("found.grams") / enough)
    clear = (F.col("found.score") >= limit * share(min(SHORT, size))) & (F.col("found.gap") >= F.lit(min_gap) * share(size))
    return scored.filter((F.col("found.lang") != UNKNOWN) & clear).select("row.*")


def op10_rank_order_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
