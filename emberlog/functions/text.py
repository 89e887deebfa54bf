"""Reading text: cleaning, normalising, parsing, plausibility, display.

Digits are ASCII by contract; letters are any Unicode letter.  Everything is a column
expression, so a whole normalise-and-parse job stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted spellings of a damage number.
DAMAGE = r"(?i)^[0-9][0-9,]*(\.[0-9]+)?[kmb]?$"
SUFFIXED = r"^[0-9]{1,5}(\.[0-9]{1,3})?[KMB]$"
PLAIN = r"^[0-9]{2,10}$"
COMMA_SUFFIXED = r"^[0-9]{1,3},[0-9]{3}[KMBkmb]$"
SHORT_TAIL = r"^[^,.]*,[^,.]{1,2}$"
# A lone comma before one or two characters: a decimal point if a letter follows, else ambiguous.
DECIMAL_COMMA = r"^([^,.]*),([^,.]{1,2})(\p{L})$"
AMBIGUOUS = r"^[^,.]*,([^,.]?[^,.\p{L}])$"
NOISE = r"[^0-9kKmMbB,.\-]"
LOOSE_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?\s*$"
LOOSE_PLAUSIBLE = r"^([0-9]+|[0-9]+(\.[0-9]+)?[KMBkmb]|[0-9]+\.[0-9]+)$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _compact(text: Column) -> Column:
    return F.replace(strip(text), F.lit(" "), F.lit(""))


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "OoS", "005"), NOISE, "")


def normalize(text: Column) -> Column:
    """Upper-case suffix; a lone comma before one or two digits is a decimal point when a suffix
    follows; other commas go.  The text is referenced twice only, to keep generated code small."""
    s = F.regexp_replace(_compact(text), DECIMAL_COMMA, "$1.$2$3")
    s = F.replace(s, F.lit(","), F.lit(""))
    return F.concat(F.regexp_replace(s, "(?s).$", ""), F.upper(F.substring(s, -1, 1)))


def _scale(suffix: Column) -> Column:
    return F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).otherwise(F.lit(1.0))


def parse_normalized(n: Column) -> Column:
    number = F.translate(n, "KMB", "").try_cast("double")
    return F.when(n.rlike(DAMAGE), (number * _scale(F.substring(n, -1, 1))).try_cast("bigint"))


def parse_value(text: Column) -> Column:
    return parse_normalized(normalize(text))


def plausible_from(text: Column, n: Column, value: Column) -> Column:
    """Plausibility of ``text`` given its normal form and parsed value."""
    s = _compact(text)
    return (
        F.when(s == "", False)
        .when(s.rlike(COMMA_SUFFIXED), True)
        .when(s.rlike(AMBIGUOUS), False)
        .when(value.isNull() | (value <= 0), False)
        .otherwise(n.rlike(SUFFIXED + "|" + PLAIN))
    )


def is_plausible(text: Column) -> Column:
    n = normalize(text)
    return plausible_from(text, n, parse_normalized(n))


def read_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``normalized``, ``parsed_value`` and ``is_plausible``, each computed once per row.

    The first two are staged projections.  The last goes through ``inline``, which later
    filters cannot be pushed below: otherwise a filter on it, or on anything built from it,
    would be rewritten in terms of the raw text and repeat the whole chain many times over.
    """
    staged = df.withColumn("normalized", normalize(F.col(text))).withColumn("parsed_value", parse_normalized(F.col("normalized")))
    flag = plausible_from(F.col(text), F.col("normalized"), F.col("parsed_value"))
    return staged.select("*", F.inline(F.array(F.struct(flag.alias("is_plausible")))))


def classify(text: Column) -> Column:
    s = strip(text)
    return (
        F.when(s == "", "unknown")
        .when(F.lower(s).contains("gold"), "gold")
        .when(s.rlike(DAMAGE), "damage")
        .when(s.rlike(r"\p{L}"), "item")
        .otherwise("unknown")
    )


def loose_parse(text: Column) -> Column:
    """The scorer's own parser: no comma handling, bare decimals allowed."""
    s = F.upper(strip(text))
    suffixed = s.rlike("[KMB]$")
    body = F.when(suffixed, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    scale = F.when(suffixed, _scale(F.right(s, F.lit(1)))).otherwise(F.lit(1.0))
    return F.when(body.rlike(LOOSE_NUMBER), (F.trim(body).try_cast("double") * scale).try_cast("bigint"))


def loose_plausible(text: Column) -> Column:
    return F.coalesce(text.rlike(LOOSE_PLAUSIBLE), F.lit(False))


def reading_score(text: Column) -> Column:
    """Preference score among several readings of one region."""
    n = F.length(text)

    def bonus(cond: Column, points: float) -> Column:
        return F.when(cond, points).otherwise(0.0)

    return F.when(n == 0, -10.0).otherwise(
        bonus(parse_value(text).isNotNull(), 10.0)
        + bonus(text.rlike("[0-9]"), 3.0)
        + bonus(text.rlike("[kKmMbB]"), 1.5)
        + bonus(text.rlike("[.,]"), 1.0)
        + bonus(n < 2, -3.0)
        + bonus(n > 10, -2.0)
    )


def frame_number(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"frame_([0-9]+)", 1).try_cast("int"), F.lit(-1))


def grouped_number(value: Column) -> Column:
    """Thousands separators; two decimals only when there is a fraction."""
    whole = value == F.floor(value)
    return F.when(whole, F.format_number(value.cast("bigint"), 0)).otherwise(F.format_number(value, 2))


def short_number(value: Column) -> Column:
    """``12.3K`` style: one decimal, dropped when zero."""
    v = value.cast("double")
    unit, scaled = F.lit(""), v
    for size, letter in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        unit = F.when(v >= size, letter).otherwise(unit)
        scaled = F.when(v >= size, v / size).otherwise(scaled)
    text = F.concat(F.regexp_replace(fixed(scaled, 1), r"\.0$", ""), unit)
    return F.when(value.isNull() | (value == 0), "0").when(v < 1000, v.cast("bigint").cast("string")).otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals without grouping; rounds the stored binary value, exact ties to even."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def clock(elapsed_ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(elapsed_ms / 1000)).cast("bigint")
    minutes = F.floor(s / 60).cast("string")
    padded = F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes)
    return F.concat(padded, F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def config_hash(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(";", *parts)), 1, 8)
