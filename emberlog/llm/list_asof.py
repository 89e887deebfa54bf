"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (``add`` or ``remove``) become validity intervals, and an as-of join evaluates each capture against the
entries that were active when it was fetched.  An entry names a whole URL, a path prefix, a host or a parent domain; a
capture is looked up under every key it could be listed by.

Entries of one list and key at one instant are one: a removal outranks an addition.  An interval starts at its entry and
ends before the next entry of its list and key.  Entries with a NULL in any column are not used.  A capture with a NULL URL
or time matches nothing; repeated captures are judged each by itself.  Times are seconds.

Entries are copied to as many salts as their key has ``PER_TASK`` captures, so a host that holds a third of all captures is
judged by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.llm.common import salted_join, table
from emberlog.operators.timeline import previous_row
from emberlog.session import cut_lineage

#: Captures of one key that one task judges.
PER_TASK = 20_000
#: Seconds of entries in one bin when intervals are closed.
BIN_SECONDS = 90 * 86_400
#: Scopes from the narrowest.
SCOPES = ["url", "prefix", "host", "domain"]
ENTRY = ["list", "scope", "value"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user and port) and the rest without a fragment."""
    bare = F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@|:[0-9]*$", ""))
    return host, F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)


def url_keys(url: Column) -> Column:
    """All ``(scope, value)`` under which a URL can be listed; empty for NULL."""
    host, rest = url_parts(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(rest, r"^/?([^?]*)", 1), "/"), lambda s: s != "")

    def key(scope: str, value: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), value.alias("value"))

    one = F.lit(1)
    parents = F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(parents, lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    counts = F.when(F.size(steps) > 0, F.sequence(one, F.size(steps))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(counts, lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, one, i), "/"))))
    own = F.array(key("url", F.concat(host, rest)), key("host", host), key("domain", host))
    return F.when(url.isNotNull(), F.concat(own, domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, scope, value, valid_from, valid_to)`` of entries ``(list, scope, value, action, at)``; open intervals end in NULL."""
    used = entries.select(*ENTRY, "action", F.col("at").cast("bigint").alias("at")).na.drop()
    once = used.groupBy(*ENTRY, "at").agg(F.max("action").alias("action"))  # "remove" is the greater word
    turned = once.withColumn("back", -F.col("at"))
    closed = previous_row(turned, ENTRY, "back", ["at"], width=BIN_SECONDS)
    return closed.filter(F.col("action") == "add").select(*ENTRY, F.col("at").alias("valid_from"), F.col("prev_at").alias("valid_to"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures (id…, url, fetched_at)`` with ``blocked, n_active, lists, scope, value, since`` of the narrowest active entry.

    ``lists`` holds the names of the lists with an active entry, in order; the narrowest entry is that of the narrowest
    scope, then the longest value, then the first list.
    """
    rows = cut_lineage(captures.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")))
    keyed = rows.filter(F.col("row.fetched_at").isNotNull())
    keyed = keyed.select("rid", F.col("row.fetched_at").cast("bigint").alias("at"), F.explode(url_keys(F.col("row.url"))).alias("key")).select("rid", "at", "key.*")
    spans = cut_lineage(intervals(entries))
    loads = keyed.groupBy("scope", "value").agg(F.floor(F.count("*") / PER_TASK).cast("int").alias("more"))
    listed = spans.select("scope", "value", "list").distinct().join(loads, ["scope", "value"])
    wanted = salted_join(keyed, listed, ["scope", "value"], F.col("rid"), "inner")
    wanted = wanted.select(*ENTRY, F.pmod(F.xxhash64("rid"), F.col("more") + 1).cast("int").alias("salt"), "at", "rid", F.lit(None).cast("struct<valid_from:bigint,valid_to:bigint>").alias("span"))
    copies = spans.join(listed, ENTRY).select(*ENTRY, F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), F.col("valid_from").alias("at"), F.lit(None).cast("bigint").alias("rid"), F.struct("valid_from", "valid_to").alias("span"))
    # As of its time: the last interval that began, itself included; intervals come before captures of the same second.
    order = W.partitionBy(*ENTRY, "salt").orderBy("at", F.col("rid").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = wanted.unionByName(copies).withColumn("span", F.last("span", ignorenulls=True).over(order)).filter(F.col("rid").isNotNull())
    active = met.filter(F.col("span").isNotNull() & (F.col("span.valid_to").isNull() | (F.col("at") < F.col("span.valid_to"))))
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope"))
    first = F.struct(rank.alias("rank"), (-F.length("value")).alias("size"), "list", "scope", "value", F.col("span.valid_from").alias("since"))
    by_row = active.groupBy("rid").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min(first).alias("first"))
    out = rows.join(by_row, "rid", "left")
    return out.select(
        "row.*", F.col("first").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0).cast("bigint")).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "first.scope", "first.value", "first.since"
    )


START = 1_704_067_200  # 2024-01-01 UTC
DAY = 86_400


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, spread over two years by id."""
    return pages.select("page_id", "url", (F.lit(START) + F.col("page_id") * 7919 % 730 * DAY).cast("bigint").alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated entry for every page: its id gives the list, the scope, the action and the day."""
    host, rest = url_parts(F.col("url"))
    step = F.regexp_extract(rest, r"^/?([^/?]*)", 1)
    kind = F.col("page_id") % 4
    value = F.when(kind == 0, F.concat(host, rest)).when(kind == 1, F.concat(host, F.lit("/"), step)).when(kind == 2, host).otherwise(F.regexp_replace(host, r"^[^.]*\.", ""))
    scope = F.when(kind == 0, "url").when(kind == 1, "prefix").when(kind == 2, "host").otherwise("domain")
    action = F.when(F.floor(F.col("page_id") / 7) % 3 == 0, "remove").otherwise("add")
    at = F.lit(START) + F.col("page_id") * 104_729 % 730 * DAY
    return pages.select(F.concat(F.lit("list"), F.col("page_id") % 3).alias("list"), scope.alias("scope"), value.alias("value"), action.alias("action"), at.cast("bigint").alias("at"))


def op3_list_asof_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(page_captures(pages), page_entries(pages))


OP3_SQL = rf"""
WITH p AS (SELECT page_id, url, {START} + page_id * 7919 % 730 * {DAY} AS fetched_at, regexp_replace(regexp_replace(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//', ''), '#.*$', '') AS bare FROM pages),
h AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host, regexp_extract(bare, '^[^/?]*(.*)$', 1) AS rest FROM p),
c AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(regexp_extract(rest, '^/?([^?]*)', 1), '/'), lambda s: s <> '') AS steps FROM h),
keyed AS (
    SELECT page_id, fetched_at, 'url' AS scope, host || rest AS value FROM c
    UNION ALL SELECT page_id, fetched_at, 'host', host FROM c
    UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(labels[i:], '.') FROM c, unnest(range(1, greatest(len(labels), 2))) AS u(i)
    UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(steps[:i], '/') FROM c, unnest(range(1, len(steps) + 1)) AS u(i)),
e AS (SELECT 'list' || page_id % 3 AS list, ['url', 'prefix', 'host', 'domain'][page_id % 4 + 1] AS scope,
    CASE page_id % 4 WHEN 0 THEN host || rest WHEN 1 THEN host || '/' || regexp_extract(rest, '^/?([^/?]*)', 1) WHEN 2 THEN host ELSE regexp_replace(host, '^[^.]*\.', '') END AS value,
    CASE WHEN page_id // 7 % 3 = 0 THEN 'remove' ELSE 'add' END AS action, {START} + page_id * 104729 % 730 * {DAY} AS at_s FROM c),
o AS (SELECT list, scope, value, at_s, max(action) AS action FROM e WHERE value IS NOT NULL GROUP BY ALL),
spans AS (SELECT list, scope, value, at_s AS valid_from, lead(at_s) OVER (PARTITION BY list, scope, value ORDER BY at_s) AS valid_to, action FROM o),
active AS (SELECT k.page_id, s.list, k.scope, k.value, s.valid_from AS since, row_number() OVER (PARTITION BY k.page_id
        ORDER BY list_position(['url', 'prefix', 'host', 'domain'], k.scope), length(k.value) DESC, s.list) AS place
    FROM keyed k JOIN spans s ON k.scope = s.scope AND k.value = s.value AND s.action = 'add' AND k.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to)),
by_page AS (SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists FROM active GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, a.scope IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, a.scope, a.value, a.since
FROM c LEFT JOIN by_page USING (page_id) LEFT JOIN active a ON a.page_id = c.page_id AND a.place = 1
"""
