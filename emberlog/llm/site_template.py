"""Main text of web pages by site template removal.

Each page is read as a tree of elements.  Subtrees of block elements are hashed, and Spark counts on how many different pages of
a host each hash occurs; copies of one page count once.  Recurring subtrees are the site's template and are deleted first, wherever
they stand: on ``MIN_PAGES`` pages and ``SHARE`` of a host's pages, or on ``MANY`` pages, or on all pages of a host with three or four.
Outside ``article`` and ``main`` of a page that has them, and in what the markup names as furniture, ``MIN_PAGES`` pages are enough.
Prose (paragraphs, headings, cells) is never deleted by count unless a container around it recurs as a whole, as quotations recur
too, and inline elements never are; lists and tables are containers outside ``article`` and ``main`` only.

Names decide what counts have left: scripts, forms, menus, adverts, comments and the like go.  ``html``, ``body``, ``main`` and
``article`` never go by a name, nor does a block that a class, id, role or ``hidden`` names or a form if it holds most of the text that
is left, or most of that of ``article`` and ``main`` it stands in.  Outside them it goes all the same if they hold a quarter of all, and comments and
adverts go if they hold any.  Of the rest only ``main`` and ``article`` stay, where they
hold a quarter of it (a half, if there is no ``main``).

A NULL or empty page has empty text.  Pages are treated by row, so repeated rows and NULL ids are pages of their own; pages
without a host are counted together.  Unclosed and stray tags are repaired the way browsers do in the common cases; reading
takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import salted_join, table
from emberlog.session import cut_lineage

#: A template subtree is on this many different pages of its host, and on this share of them.
MIN_PAGES, SHARE = 5, 0.3
#: A subtree on so many different pages is one whatever their share, as large hosts have sections.
MANY = 500
#: Shares of the text left that ``main``, or articles alone, must hold to stand for the page.
MAIN_SHARE, ARTICLE_SHARE = 0.25, 0.5

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd thead tbody tfoot tr td th caption figure figcaption hgroup address option optgroup".split())
#: Containers outside ``article`` and ``main``, prose inside.
LISTS = frozenset("ul ol dl table dir".split())
#: No name or count removes these.
WHOLE = frozenset("html body main article".split())
FURNITURE = frozenset("head nav aside footer form menu dialog button select option search svg canvas object audio video map input label fieldset datalist".split())
#: Whole names in ``class``, ``id`` and ``role`` that name furniture.
NAMED = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar comment comments "
    "disqus respond replies related recommended share sharing social pagination pager search widget complementary contentinfo dialog hidden header "
    "ad-box ad-container ad-slot cookie-banner cookie-notice cookie-consent site-header site-footer main-navigation nav-menu navbar-nav social-share "
    "share-buttons related-posts comment-list comments-area comment-respond".split()
)
#: Of these, comments and adverts, which are never the main part where ``article`` or ``main`` has text.
BESIDE = frozenset(
    "comment comments disqus respond replies comment-list comments-area comment-respond ad ads advert advertisement advertising adsense banner sponsor sponsored "
    "promo promotion cookie cookies consent gdpr ad-box ad-container ad-slot cookie-banner cookie-notice cookie-consent".split()
)
#: A start tag ends the open element of one of these names, unless one of those stands between.
ENDS = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
P_SCOPE = frozenset("table td th caption button object".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
READ_AS = {"class", "id", "role", "hidden"}
#: Where a piece stands.
ARTICLE, MAIN, GONE = 1, 2, 4
#: What names a block: a form or a name of furniture, a name of comments or adverts.
NAMED_BLOCK, BESIDE_BLOCK = 1, 2
PAGE = "struct<sig:bigint,parts:array<bigint>>"


class Page:
    """Text pieces of one page in order (``None`` parts blocks) and its hashed subtrees."""

    def __init__(self, source: str):
        self.source = source
        self.pieces: list[str | None] = []
        self.where: list[int] = []  # ARTICLE, MAIN, GONE (furniture by its element)
        self.subtrees: list[tuple[int, int, int, int, bool]] = []  # hash, first, last, where, furniture by a name
        self.names: list[tuple[int, int, int, bool]] = []  # first, last, kind, inside article or main
        self.stack: list[list] = []  # name, where, first piece, children, kind
        self.open: Counter = Counter()
        self._read()

    def _read(self) -> None:
        src, at, no_more = self.source, 0, set()
        while (lt := src.find("<", at)) >= 0:
            self._text(src[at:lt])
            if src.startswith("<!--", lt):
                end = src.find("-->", lt + 4)
                at = len(src) if end < 0 else end + 3
                continue
            closing = src.startswith("/", lt + 1)
            name = NAME.match(src, lt + 1 + closing)
            if not name:
                if closing or src[lt + 1 : lt + 2] in ("!", "?"):
                    end = src.find(">", lt)
                    at = len(src) if end < 0 else end + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            at = end = name.end()
            while (m := TAG_END.search(src, end)) and m[0] != ">":
                close = -1 if m[0] in no_more else src.find(m[0], m.end())
                if close < 0:
                    no_more.add(m[0])
                end = m.end() if close < 0 else close + 1
            stop = m.start() if m else len(src)
            tag = name[0].lower()
            if closing:
                self._end(tag)
            else:
                self._start(tag, src[at:stop])
            at = min(len(src), stop + 1)
            if not closing and tag in RAW:
                m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(src, at)
                at = m.start() if m else len(src)
        self._text(src[at:])
        while self.stack:
            self._pop()

    def _add(self, piece: str | None) -> None:
        self.pieces.append(piece)
        self.where.append(self.stack[-1][1] if self.stack else 0)

    def _text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1][0] in RAW):
            text = html.unescape(raw) if "&" in raw else raw
            self._add(text)
            if self.stack:
                self.stack[-1][3].append(" ".join(text.split()))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open[tag]:
            return
        if tag in BLOCK:
            self._end_paragraph()
            if self.open["head"] and tag not in ("head", "title"):
                self._end("head")
        if tag in ENDS:
            ended, barriers = ENDS[tag]
            if any(self.open[t] for t in ended):
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in ended:
                        self._pop_to(i)
                        break
                    if self.stack[i][0] in barriers:
                        break
        if tag == "br":
            self._add(" ")
        if tag in BLOCK:
            self._add(None)
        if tag in VOID:
            return
        where = self.stack[-1][1] if self.stack else 0
        names: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            if (key := m[1].lower()) in READ_AS:
                names.setdefault(key, (m[2] or m[3] or m[4] or "").lower())
        words = {w for key in ("class", "id", "role") for w in names.get(key, "").split()}
        kind = 0
        if tag in WHOLE:
            where |= ARTICLE * (tag == "article") | MAIN * (tag == "main")
        else:
            if tag in RAW or tag in FURNITURE and tag != "form" or tag == "header" and not where & 3:
                where |= GONE
            elif "main" in names.get("role", "").split():
                where |= MAIN
            elif words & BESIDE:
                kind = BESIDE_BLOCK
            elif tag == "form" or "hidden" in names or words & NAMED and not (words & NAMED == {"header"} and where & 3):
                kind = NAMED_BLOCK
        label = f"{tag} {names.get('class', '')} {names.get('id', '')}"
        self.stack.append([tag, where, len(self.pieces), [label], kind])
        self.open[tag] += 1

    def _end_paragraph(self) -> None:
        if self.open["p"]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._pop_to(i)
                    break
                if self.stack[i][0] in P_SCOPE:
                    break

    def _end(self, tag: str) -> None:
        if not self.open[tag]:
            if tag in ("p", "br"):
                self._add(None if tag == "p" else " ")
            return
        inline = tag not in BLOCK and tag not in RAW
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return
            if inline and self.stack[i][0] in BLOCK:
                return

    def _pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            self._pop()

    def _pop(self) -> None:
        tag, where, first, children, kind = self.stack.pop()
        self.open[tag] -= 1
        above = self.stack[-1][1] if self.stack else 0
        digest = xxhash.xxh3_64_intdigest("\x1f".join(children))
        if len(self.pieces) > first:
            if kind:
                self.names.append((first, len(self.pieces), kind, bool(above & 3)))
            named = bool(kind or where & GONE)
            if tag in BLOCK and tag not in WHOLE and tag != "head" and (tag not in PROSE or named) and not (tag in LISTS and where & 3 and not named):
                self.subtrees.append((digest, first, len(self.pieces), where, named))
        if self.stack and tag not in RAW:
            self.stack[-1][3].append(f"{digest:x}")
        if tag in BLOCK:
            self._add(None)

    def parts(self) -> list[dict]:
        """Subtrees open to deletion by count; ``free`` are those for which few pages suffice."""
        region = any(w & 3 and not w & GONE and p and not p.isspace() for p, w in zip(self.pieces, self.where, strict=True))
        return [{"hash": h - (1 << 63), "first": a, "last": b, "free": named or region and not w & 3} for h, a, b, w, named in self.subtrees]


def left(pieces: list[str | None], places: list[int], names: list[tuple[int, int, int, bool]], deleted: list[tuple[int, int]] = ()) -> str:
    """The text of a page without the ranges ``deleted``, what names call furniture and what stands beside its main part."""
    n = len(pieces)
    stays = bytearray(not w & GONE for w in places)
    reach = 0
    for a, b in sorted(deleted):
        if b > reach:
            stays[max(a, reach) : b] = bytes(b - max(a, reach))
            reach = b

    def sums(inside: int) -> list[int]:
        out = [0]
        for p, w, s in zip(pieces, places, stays, strict=True):
            out.append(out[-1] + (len("".join(p.split())) if p and s and (w & 3 or not inside) else 0))
        return out

    everywhere, core = sums(0), sums(3)

    def remove(ranges: list[tuple[int, int, int, bool]]) -> bytearray:
        out, reach = bytearray(stays), 0
        for a, b, *_ in sorted(ranges):
            if b > reach:
                out[max(a, reach) : b] = bytes(b - max(a, reach))
                reach = b
        return out

    if everywhere[n]:
        unnamed = sum(len("".join(p.split())) for p, w, s in zip(pieces, places, remove(names), strict=True) if p and s and w & 3)
        most = [
            2 * (everywhere[b] - everywhere[a]) > everywhere[n] and (inside or unnamed < MAIN_SHARE * everywhere[n]) or inside and 2 * (core[b] - core[a]) > core[n]
            for a, b, _, inside in names
        ]
        if any(most):
            out = remove([x for x, m in zip(names, most, strict=True) if not m or x[2] == BESIDE_BLOCK])
            other = any(s and w & 3 and p and not p.isspace() for p, w, s in zip(pieces, places, out, strict=True))
            removed = [x for x, m in zip(names, most, strict=True) if not m or x[2] == BESIDE_BLOCK and other]
        else:
            removed = names
        all_left = stays
        stays = remove(removed)
        everywhere = sums(0)
        if not everywhere[n]:  # names took everything
            stays = all_left
            everywhere = sums(0)
        core = sums(3)
        has_main = any(s and w & MAIN and p and not p.isspace() for p, w, s in zip(pieces, places, stays, strict=True))
        if core[n] and core[n] >= (MAIN_SHARE if has_main else ARTICLE_SHARE) * everywhere[n]:
            stays = bytearray(s and bool(w & 3) for s, w in zip(stays, places, strict=True))
    return joined([p for p, s in zip(pieces, stays, strict=True) if s or p is None])


def joined(pieces: list[str | None]) -> str:
    """Blocks with single spaces inside, parted by two line feeds."""
    blocks, held = [], []
    for piece in [*pieces, None]:
        if piece is None:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held = []
        else:
            held.append(piece)
    return "\n\n".join(blocks)


def read_page(source: str | None) -> dict:
    """The text of a page where nothing recurs, its checksum, and the hashes of its parts."""
    page = Page(source or "")
    text = left(page.pieces, page.where, page.names)
    return {"text": text, "sig": xxhash.xxh3_64_intdigest(text) - (1 << 63), "parts": list({p["hash"]: None for p in page.parts()})}


def without_template(source: str | None, template: dict[int, bool]) -> str:
    """The text of a page without the subtrees of ``template``, from a hash to whether it goes from any place."""
    page = Page(source or "")
    gone = [(p["first"], p["last"]) for p in page.parts() if p["hash"] in template and (p["free"] or template[p["hash"]])] if template else []
    return left(page.pieces, page.where, page.names, gone)


def _reader():
    @F.arrow_udf(PAGE)
    def read(sources: pa.Array) -> pa.Array:
        kind = pa.struct([("sig", pa.int64()), ("parts", pa.list_(pa.int64()))])
        return pa.array([read_page(s.as_py()) for s in sources], kind)

    return read


def _packer():
    @F.arrow_udf("binary")
    def pack(sources: pa.Array) -> pa.Array:
        out = []
        for s in sources:
            raw = (s.as_py() or "").encode()
            out.append(len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))
        return pa.array(out, pa.binary())

    return pack


def _without():
    @F.arrow_udf("string")
    def without(packed: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for p, h in zip(packed, hashes, strict=True):
            p = p.as_py()
            source = pa.decompress(p[8:], int.from_bytes(p[:8], "little"), "zstd", asbytes=True).decode()
            out.append(without_template(source, {x["hash"]: x["sure"] for x in h.as_py() or ()}))
        return pa.array(out, pa.string())

    return without


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(read: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """``(host, hash, sure)`` of recurring subtrees among ``read (host, page)``; pages of one text count once.

    ``sure`` are those that recur often enough to go from any place, the others go where few pages suffice.
    """
    pages = read.select("host", F.col("page.sig").alias("sig")).distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    found = read.select("host", F.col("page.sig").alias("sig"), F.explode("page.parts").alias("hash"))
    n, total = F.col("n"), F.col("n_pages")
    counts = found.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).filter(n >= F.least(F.lit(3), F.lit(min_pages)))
    sure = ((n >= min_pages) & (n >= share * total)) | (n >= many) | (n == total)
    return salted_join(counts, pages, ["host"], F.col("hash"), "inner").filter(sure | (n >= min_pages)).select("host", "hash", sure.alias("sure"))


def page_parts(read: DataFrame, found: DataFrame) -> DataFrame:
    """``(rid, hash, sure)``: the template hashes ``found`` that each page holds."""
    mine = read.select("rid", "host", F.explode("page.parts").alias("hash"))
    return salted_join(mine, found, ["host", "hash"], F.col("rid"), "inner").select("rid", "hash", "sure")


def _rid() -> Column:
    """Of a row's content: the pages are read twice rather than written.  Rows that share one share what is deleted if it is in them."""
    return F.xxhash64(F.col("page_id"), F.col("url"), F.col("html")).alias("rid")


def read_pages(pages: DataFrame) -> DataFrame:
    return cut_lineage(pages.select(_rid(), host_of(F.col("url")).alias("host"), _reader()(F.col("html")).alias("page")))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``."""
    read = read_pages(pages)
    gone = page_parts(read, templates(read, min_pages, share, many)).groupBy("rid").agg(F.collect_set(F.struct("hash", "sure")).alias("hashes"))
    rows = pages.select("page_id", "url", _rid(), _packer()(F.col("html")).alias("packed"))
    text = _without()("packed", "hashes").alias("text")
    return rows.join(gone, "rid", "left").select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("bigint"))


def op1_site_template_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
