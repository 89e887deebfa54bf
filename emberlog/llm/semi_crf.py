"""Personal data by rules and a semi-Markov conditional random field.

Four kinds are fixed by rules (``base_spans``) and always stay.  The field adds spans of its own kinds: it splits a stretch of
tokens into segments, scores each candidate segment as a whole (character classes, digit counts, checksums, octets, the
word before it, what stands beside it), and dynamic programming over segments of at most ``LONGEST`` tokens chooses
boundaries and kinds together.  A token outside all segments scores nothing, so stretches far from any digit or ``@`` need no work
and whole texts are covered.  The weights are trained here, by the averaged structured perceptron, on at most
``SAMPLE`` texts of the corpus, of fewer than ``MOST`` characters each, whose labels are the rules and a few sure forms of credentials.

NULL and empty texts have no span.  Rows are treated one by one, so repeated rows and NULL ids need no care.  Spans are
code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds only the field finds: identifiers of access keys, and secrets given by name.
MORE_KINDS = ("access_key", "secret")
KINDS = BASE_KINDS + MORE_KINDS
#: Tokens in a segment.
LONGEST = 24
#: Texts the weights are trained on, and characters of such a text.
SAMPLE, MOST = 400, 20_000
#: Characters of a stretch used in training.
TRAINED = 400
EPOCHS = 4

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Sure forms of credentials, the labels of the added kinds in training.
SURE = {
    "access_key": re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?i:password|passwd|secret|token|api_key|apikey) ?[=:] ?\"?([A-Za-z0-9]{12,})(?![A-Za-z0-9])"),
}
TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")
TRIGGER = re.compile(r"[0-9@]|AKIA")
#: Signs that tie words together.
JOINTS = tuple("._-@%+")
NAMES = frozenset("password passwd pwd secret token key apikey api auth credential".split())
SPAN = "array<struct<kind:string,start:int,stop:int>>"
#: Characters a segment of each kind may hold.
ALLOWED = {
    "email": re.compile(r"[A-Za-z0-9._%+@-]+"),
    "ip": re.compile(r"[0-9.]+"),
    "card": re.compile(r"[0-9 -]+"),
    "phone": re.compile(r"[0-9 +().-]+"),
    "access_key": re.compile(r"[A-Z0-9]+"),
    "secret": re.compile(r"[A-Za-z0-9_/+-]+"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the longest run of local characters before it (after the last match) and a domain of two labels or more."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        elif start < at:
            done = max(done, at)  # no match can begin before a failed sign and end after it
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans fixed by rules, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def sure_spans(text: str) -> list[tuple[str, int, int]]:
    """Labels for training: the rules, then sure credentials that touch none of their spans."""
    out = base_spans(text)
    for kind, form in SURE.items():
        for m in form.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if all(b <= s or a >= e for _, s, e in out):
                out.append((kind, a, b))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of whole blank-separated words about a digit, an ``@`` or a key's prefix; words parted by one blank join."""
    out: list[list[int]] = []
    done = 0
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = max(text.rfind(" ", done, m.start()), text.rfind("\n", done, m.start())) + 1 or done
        end = min(e for e in (text.find(" ", m.end()), text.find("\n", m.end()), len(text)) if e >= 0) if len(text) - m.end() < 200 else _end(text, m.end())
        if out and start - out[-1][1] <= 1:
            out[-1][1] = end
        else:
            out.append([start, end])
        done = end
    return [(a, b) for a, b in out]


BLANK = re.compile(r"[ \n]")


def _end(text: str, at: int) -> int:
    m = BLANK.search(text, at)
    return m.start() if m else len(text)


def _word_before(text: str, start: int) -> str:
    """The last word of letters close before a position, past signs of assignment."""
    head = text[max(0, start - 24) : start].rstrip(" =:\"'")
    m = re.search(r"[A-Za-z]+$", head)
    return m[0].lower() if m else ""


def features(text: str, start: int, stop: int, kind: str) -> list[str]:
    """Features of a whole candidate segment."""
    span = text[start:stop]
    left, right = text[start - 1 : start], text[stop : stop + 1]
    digits = sum(c.isdigit() and c.isascii() for c in span)
    out = ["bias", f"digits:{0 if not digits else 1 if digits < 8 else 2 if digits < 16 else 3 if digits < 20 else 4}"]
    out.append(f"cut:{left.isalnum()}{right.isalnum()}")
    out.append(f"more:{left in JOINTS and text[start - 2 : start - 1].isalnum()}{right in JOINTS and text[stop + 1 : stop + 2].isalnum()}")
    out.append(f"ends:{span[0].isalnum() or span[0] == '+'}{span[-1].isalnum()}")
    if kind == "email":
        user, _, host = span.partition("@")
        out.append(f"at:{span.count('@')}{bool(user)}{'.' in host and all(host.split('.'))}")
    elif kind == "ip":
        parts = span.split(".")
        out.append(f"octets:{len(parts) == 4 and all(p and len(p) < 4 and int(p) < 256 for p in parts)}{right == '.'}")
    elif kind == "card":
        bare = span.replace(" ", "").replace("-", "")
        out.append(f"luhn:{16 <= len(bare) <= 19 and bare.isdigit() and luhn(bare)}")
    elif kind == "phone":
        out.append(f"plus:{span[0] == '+'}{span.count('+') == 1}{8 <= digits <= 15}{right in ' ' and text[stop + 1 : stop + 2].isdigit()}")
    else:
        letters = stop - start - digits
        mixed = digits >= 2 and letters >= 2
        out.append(f"length:{0 if stop - start < 12 else 1 if stop - start < 20 else 2 if stop - start == 20 else 3}{mixed}")
        out.append(f"form:{span.startswith('AKIA')}{span.isupper()}")
        out.append(f"named:{_word_before(text, start) in NAMES}{mixed}")
    return [f"{kind}|{x}" for x in out]


def decode(text: str, start: int, stop: int, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best segmentation of a stretch: Viterbi over segments of at most ``LONGEST`` tokens."""
    tokens = [m.span() for m in TOKEN.finditer(text, start, stop)]
    n = len(tokens)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ends: list[list[tuple[int, str]]] = [[] for _ in range(n + 1)]
    for kind in KINDS:
        fits = [bool(ALLOWED[kind].fullmatch(text, a, b)) for a, b in tokens]
        for i in range(n):
            if fits[i] and not text[tokens[i][0]].isspace():
                for j in range(i, min(n, i + LONGEST)):
                    if not fits[j]:
                        break
                    if _possible(text, tokens[i][0], tokens[j][1], kind):
                        ends[j + 1].append((i, kind))
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], None
        for i, kind in ends[j]:
            score = best[i] + sum(weights.get(f, 0.0) for f in features(text, tokens[i][0], tokens[j - 1][1], kind))
            if score > best[j]:
                best[j], back[j] = score, (i, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


def _possible(text: str, start: int, stop: int, kind: str) -> bool:
    """Whether a range can be a candidate of its kind at all."""
    length = stop - start
    if text[stop - 1].isspace() or length < 6 or length > 400:
        return False
    if kind == "email":
        return text.find("@", start, stop) > 0
    if kind == "phone":
        return text[start] in "+(" or text[start].isdigit()
    if kind in MORE_KINDS:
        return length >= 12
    return text[start].isdigit() and text[stop - 1].isdigit()


def train(texts: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Averaged structured perceptron on weakly labelled texts."""
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    work = []
    for text in texts:
        gold = sure_spans(text)
        for a, b in stretches(text):
            if b - a <= TRAINED:
                work.append((text, a, b, [(k, s, e) for k, s, e in gold if a <= s and e <= b]))
    step = 1
    for _ in range(epochs):
        for text, a, b, gold in work:
            found = decode(text, a, b, weights)
            for sign, spans in ((1.0, gold), (-1.0, found)):
                for kind, s, e in spans:
                    if (kind, s, e) not in (found if sign > 0 else gold):
                        for f in features(text, s, e, kind):
                            weights[f] += sign
                            total[f] += sign * step
            step += 1
    return {f: w - total[f] / step for f, w in weights.items()}


def find(text: str, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """All spans: those of the rules, and those of the field that touch none of them."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, at = [], 0
    for a, b in stretches(text):
        for kind, s, e in decode(text, a, b, weights):
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at == len(taken) or e <= taken[at][0]:
                added.append((kind, s, e))
    return base + added


def trained(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from a fixed number of texts with a digit or ``@`` and below ``MOST`` characters: those of the least checksums.

    Tasks hand over checksums only; then the few texts that have them are fetched, one for each.
    """
    useful = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") < MOST))
    crc = F.crc32("text").alias("crc")
    least = [r["crc"] for r in useful.select(crc).distinct().orderBy("crc").limit(sample).collect()]
    picked = useful.select(crc, "text").filter(F.col("crc").isin(least)).groupBy("crc").agg(F.min("text").alias("text"))
    return train([r["text"] for r in sorted(picked.collect(), key=lambda r: r["crc"])])


def recogniser(weights: dict[str, float]):
    """Column function ``text -> spans`` ordered by kind and start; the first ``n_base`` are those of the rules."""

    @F.arrow_udf(f"struct<n_base:int,spans:{SPAN}>")
    def recognise(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        sizes, out = [], []
        for text in texts:
            text = text.as_py() or ""
            spans = find(text, weights)
            base = len(base_spans(text)) if spans else 0
            sizes.append(base)
            out.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(out, kind)], ["n_base", "spans"])

    return recognise


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``n_base`` and ``spans`` (kind, start, stop), the spans of the rules first."""
    docs = docs.select("doc_id", "text")
    found = docs.select("doc_id", recogniser(trained(docs, sample))(F.col("text")).alias("found"))
    return found.select("doc_id", "found.n_base", "found.spans")


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op2_semi_markov_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.slice("spans", F.lit(1), F.col("n_base"))
    order = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(F.array_position(order, s["kind"]).alias("at"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(ordered).alias("spans"))
