"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over the text's words with a label, a priority (1 is best), a confidence and a keyword.  Texts without any
keyword are settled by one pass; for the others only rules whose keyword stands in the text are run.  A detection is
suppressed when another of the same or a better priority contains it; of equal ranges the first rule's stays.  The rules of
the four base phrases are counted whatever suppresses them.

Words are runs of digits, A-Z (lower-cased) and characters beyond ASCII.  NULL and empty texts have no word.  Rows are
treated one by one, so repeated rows and NULL ids are rows of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.llm.common import table
from emberlog.session import cut_lineage

# The base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Keywords of rules; a rule can only match where its keyword stands.
GATES = ["licens", "licenc", "copyright", "spdx", "creative commons", "cc by", "cc0", "public domain", "rights reserved", "gpl", "warranty", "patent"]

# Licenses: label, keyword of the name, the name as words.
NAMES = [
    ("apache-2.0", "licens", "apache (software )?license( version)? 2 0"),
    ("apache-1.1", "licens", "apache (software )?license( version)? 1 1"),
    ("gpl-2.0", "licens", "gnu general public license( version| v)? 2"),
    ("gpl-3.0", "licens", "gnu general public license( version| v)? 3"),
    ("gpl-any", "licens", "gnu general public license"),
    ("gpl-2.0", "gpl", "gpl( version| v)? ?2"),
    ("gpl-3.0", "gpl", "gpl( version| v)? ?3"),
    ("lgpl-2.1", "licens", "gnu (lesser|library) general public license( version| v)? 2( 1)?"),
    ("lgpl-3.0", "licens", "gnu lesser general public license( version| v)? 3"),
    ("agpl-3.0", "licens", "gnu affero general public license( version| v)? 3"),
    ("fdl-1.3", "licens", "gnu free documentation license( version| v)?( 1 [123])?"),
    ("mit", "licens", "mit license"),
    ("mit", "licens", "expat license"),
    ("x11", "licens", "x11 license"),
    ("isc", "licens", "isc license"),
    ("bsd-2-clause", "licens", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license"),
    ("bsd-3-clause", "licens", "(bsd 3 clause|3 clause bsd|modified bsd|new bsd|revised bsd) license"),
    ("bsd-4-clause", "licens", "(bsd 4 clause|4 clause bsd|original bsd) license"),
    ("bsd-any", "licens", "bsd( style)? license"),
    ("mpl-1.1", "licens", "mozilla public license( version| v)? 1 1"),
    ("mpl-2.0", "licens", "mozilla public license( version| v)? 2 0"),
    ("epl-1.0", "licens", "eclipse public license( version| v)? 1 0"),
    ("epl-2.0", "licens", "eclipse public license( version| v)? 2 0"),
    ("cddl-1.0", "licens", "common development and distribution license( version)?( 1 0)?"),
    ("cpl-1.0", "licens", "common public license( version)?( 1 0)?"),
    ("eupl-1.2", "licenc", "european union public licence( version| v)?( 1 [12])?"),
    ("artistic-2.0", "licens", "artistic license( version)? 2( 0)?"),
    ("artistic-1.0", "licens", "artistic license( version)? 1( 0)?"),
    ("bsl-1.0", "licens", "boost software license( version)?( 1 0)?"),
    ("zlib", "licens", "zlib( libpng)? license"),
    ("unlicense", "licens", "unlicense"),
    ("wtfpl", "licens", "do what the fuck you want to public license"),
    ("psf-2.0", "licens", "python software foundation license( version)?( 2)?"),
    ("php-3.01", "licens", "php license( version)?( 3 01)?"),
    ("ofl-1.1", "licens", "sil open font license( version)?( 1 1)?"),
    ("odbl-1.0", "licens", "open database license( version| v)?( 1 0)?"),
    ("osl-3.0", "licens", "open software license( version| v)?( 3 0)?"),
    ("ms-pl", "licens", "microsoft public license"),
    ("upl-1.0", "licens", "universal permissive license( version| v)?( 1 0)?"),
    ("postgresql", "licens", "postgresql license"),
    ("busl-1.1", "licens", "business source license( version)?( 1 1)?"),
    ("elastic-2.0", "licens", "elastic license( version)?( 2 0)?"),
    ("sspl-1.0", "licens", "server side public license( version| v)?( 1)?"),
    ("cc-by-4.0", "cc by", "cc by( 4 0)"),
    ("cc-by-sa", "cc by", "cc by sa( [1234] 0)?"),
    ("cc-by-nc", "cc by", "cc by nc( [1234] 0)?"),
    ("cc-by-nd", "cc by", "cc by nd( [1234] 0)?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa( [1234] 0)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd( [1234] 0)?"),
    ("cc-by", "creative commons", "creative commons attribution( [1234] 0)?( international| unported)?( license)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike( [1234] 0)?( international| unported)?( license)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial( [1234] 0)?( international| unported)?( license)?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(ative)?s( [1234] 0)?( international| unported)?( license)?"),
    ("cc0-1.0", "cc0", "cc0( 1 0)?( universal)?"),
    ("public-domain", "public domain", "(in|to|into) the public domain"),
]

# Ways of naming a license: confidence, priority, words before the name.
WAYS = [
    (0.95, 1, "(licensed|released|distributed|available|provided|published|covered) under( the)?( terms( and conditions)? of)?( the)? "),
    (0.9, 1, "subject to( the)?( terms( and conditions)? of)?( the)? "),
    (0.85, 1, "(see|read)( the)?( file| text of)?( the)? "),
    (0.8, 2, ""),
]

# Notices without a license name: label, keyword, confidence, priority, words.
NOTICES = [
    ("all-rights-reserved", "rights reserved", 0.7, 2, "all rights reserved"),
    ("some-rights-reserved", "rights reserved", 0.6, 2, "some rights reserved"),
    ("copyright-notice", "copyright", 0.5, 3, "copyright( c)? [0-9][0-9][0-9][0-9]"),
    ("copyright-notice", "copyright", 0.5, 3, "copyright( c)? by"),
    ("no-warranty", "warranty", 0.5, 3, "without warranty of any kind"),
    ("no-warranty", "warranty", 0.5, 3, "(without|no) warranty"),
    ("patent-grant", "patent", 0.4, 3, "patent license"),
    ("commercial", "licens", 0.6, 2, "commercial license"),
    ("proprietary", "licens", 0.6, 2, "proprietary( software)? license"),
    ("end-user", "licens", 0.6, 2, "end user license agreement"),
    ("dual-license", "licens", 0.5, 3, "dual licensed"),
    ("license-file", "licens", 0.3, 3, "see( the)? license( file)?( for details)?"),
    ("license-mention", "licens", 0.2, 4, "(licensed|license) (under|agreement|terms)"),
]

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RULE = "array<struct<rule:int,label:string,keyword:string,confidence:double,priority:int,base:boolean,pattern:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_pattern(words: str) -> str:
    """A pattern over words each of which has a blank on either side: between words stand two."""
    return " " + words.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(  )?") + " "


def rules() -> list[dict]:
    """All rules in order: base phrases, SPDX lines, the ways of naming each license, notices."""
    rows = [(label, phrase.split()[-1][:6] if "cc" not in phrase else "cc by", 0.75, 2, True, phrase) for phrase, label in BASE]
    spdx = dict.fromkeys(label for label, _, _ in NAMES)
    rows += [(label, "spdx", 1.0, 1, False, "spdx license identifier " + label.replace("-", " ").replace(".", " ")) for label in spdx]
    rows += [(label, key, confidence, priority, False, way + name) for label, key, name in NAMES for confidence, priority, way in WAYS]
    rows += [(label, key, confidence, priority, False, words) for label, key, confidence, priority, words in NOTICES]
    names = ("label", "keyword", "confidence", "priority", "base")
    return [{"rule": i, **dict(zip(names, r, strict=False)), "keyword": r[1].replace(" ", "  "), "pattern": words_pattern(r[5])} for i, r in enumerate(rows)]


def gate() -> str:
    """One pattern that any text with a keyword matches."""
    return "(?i)" + "|".join(g.replace(" ", NOT_WORD) for g in GATES)


def scan(docs: DataFrame) -> DataFrame:
    """Written rows ``(rid, doc_id, n_words, words)`` of texts with a keyword: each word between two blanks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", text.alias("text")).filter(F.col("text").rlike(gate()))
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    words = F.translate(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")), UPPER, LOWER)
    return cut_lineage(seen.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size(found).cast("bigint").alias("n_words"), words.alias("words")))


def detections(scanned: DataFrame) -> DataFrame:
    """``(rid, rule…, start, stop, word, kept)``: every match of every rule whose keyword is there; characters of ``words``."""
    every = F.from_json(F.lit(json.dumps(rules())), RULE)
    near = scanned.select("rid", "words", F.explode(F.filter(every, lambda r: F.contains(F.col("words"), r["keyword"]))).alias("r"))
    parts = F.split("words", F.col("r.pattern"), -1)
    hits = F.regexp_extract_all("words", F.col("r.pattern"), F.lit(0))
    near = near.select("rid", "r", F.posexplode(F.arrays_zip(parts.alias("part"), hits.alias("hit"))).alias("at", "x")).filter(F.col("x.hit").isNotNull())
    before = W.partitionBy("rid", "r.rule").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    done = F.coalesce(F.sum(F.length("x.part") + F.length("x.hit")).over(before), F.lit(0))
    blank = F.coalesce(F.sum(blanks(F.col("x.part")) + blanks(F.col("x.hit"))).over(before), F.lit(0))
    placed = near.select("rid", "r.*", (done + F.length("x.part")).alias("start"), F.length("x.hit").alias("n"), F.floor((blank + blanks(F.col("x.part"))) / 2).alias("word"))
    placed = placed.select("*", (F.col("start") + F.col("n")).alias("stop"))
    earlier = W.partitionBy("rid").orderBy("start", F.desc("stop"), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = F.lit(None).cast("bigint")
    for p in sorted({r["priority"] for r in rules()}):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(earlier)).otherwise(reach)
    return placed.withColumn("kept", F.coalesce(reach < F.col("stop"), F.lit(True)))


def _labels(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")


def licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scanned = scan(docs)
    base = F.col("base")
    by_row = detections(scanned).groupBy("rid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("word"))).alias("first_word"),
        F.max(F.when(base, F.col("word"))).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(base | F.col("kept")).alias("labels"),
        F.max(F.when(base | F.col("kept"), F.col("confidence"))).alias("score"),
    )
    found = scanned.select("rid", "doc_id", "n_words").join(by_row, "rid", "left").drop("rid")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.filter(~text.rlike(gate())).select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"))
    none = F.lit(None).cast("bigint")
    plain = plain.select("*", none.alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit(None).cast("string").alias("base_labels"))
    plain = plain.select("*", F.lit(None).cast("string").alias("labels"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(plain).na.fill({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op5_license_rules(spark, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _quoted(value) -> str:
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'"


_RULES_SQL = ", ".join("(" + ", ".join(_quoted(v) for v in (r["rule"], r["label"], r["keyword"], r["confidence"], r["priority"], r["base"], r["pattern"])) + ")" for r in rules())

OP5_SQL = rf"""
WITH rules(rule, label, keyword, confidence, priority, base, pattern) AS (VALUES {_RULES_SQL}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(text, '{WORD}') AS found FROM d),
t AS (SELECT rid, doc_id, len(found) AS n_words,
    translate(' ' || array_to_string(found, '  ') || ' ', '{UPPER}', '{LOWER}') AS words FROM w),
near AS (SELECT rid, words, rules.* FROM t JOIN rules ON contains(words, keyword)),
hits AS (SELECT rid, rule, label, confidence, priority, base, unnest(regexp_extract_all(words, pattern)) AS hit,
    unnest(string_split_regex(words, pattern)[:-2]) AS part, unnest(range(len(regexp_extract_all(words, pattern)))) AS pos
    FROM near WHERE regexp_matches(words, pattern)),
placed AS (SELECT rid, rule, label, confidence, priority, base, length(hit) AS n,
    coalesce(sum(length(part) + length(hit)) OVER b, 0) + length(part) AS start,
    (coalesce(sum(length(part || hit) - length(replace(part || hit, ' ', ''))) OVER b, 0) + length(part) - length(replace(part, ' ', ''))) // 2 AS word
    FROM hits WINDOW b AS (PARTITION BY rid, rule ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM placed b WHERE b.rid = a.rid AND b.priority <= a.priority AND b.start <= a.start AND b.start + b.n >= a.start + a.n
    AND (b.start, -(b.start + b.n), b.priority, b.rule) < (a.start, -(a.start + a.n), a.priority, a.rule)) AS kept FROM placed a),
by_row AS (SELECT rid, count(*) FILTER (base) AS n_base, min(word) FILTER (base) AS first_word, max(word) FILTER (base) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base OR kept))), ','), '') AS labels, max(confidence) FILTER (base OR kept) AS score
    FROM judged GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0) AS score
FROM t LEFT JOIN by_row USING (rid)
"""
