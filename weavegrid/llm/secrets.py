"""Secret scans with multipart credential linking.

A credential is often spread over parts: an access identifier, a secret and an
endpoint. ``scan`` finds strong secrets by pattern wherever they stand, and
weak candidates (short or unlabelled secrets, identifiers, endpoints) only
when complementary parts co-occur: within one scope (a run of lines without a
blank line) and at most ``REACH`` code points apart. Linking is an interval
join by a sweep over each scope's parts, sorted by start, so a text with many
parts costs n log n.

Spans are in code points, end exclusive. Base kinds:

* assign: keyword, separator and a value of 12 or more characters
* access: AKIA and upper-case letters or digits, 18 or more characters in all
* hex: 16 or more lower-case hexadecimal digits

Linked kinds: ``secret`` (labelled values of 6 to 11 characters, or unlabelled
mixed tokens of 20 or more), ``identifier`` (user or client names, short access
ids) and ``endpoint`` (URLs with a scheme, host assignments). A secret is
reported beside an identifier or endpoint, an identifier or endpoint beside a
secret, weak or base. Weak candidates that overlap a base span are part of it.
Partners are disjoint spans: what overlaps is one part, not two. Of weak
candidates one of which holds another, or which overlap, the longest counts
(then the first, then the kind as listed), so a token within a URL is part of
the URL, and the value of ``user=`` is no secret.

Defined cases: a null text counts as empty; rows may repeat or lack a doc_id;
other columns are ignored; very long texts are scanned whole, in time of n log n.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weavegrid.llm.common import ship, slices, text_or_empty

REACH = 200
BASE = ("assign", "access", "hex")
LINKED = ("secret", "identifier", "endpoint")

# The base patterns of the scan.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run that is too short to count can't hide a longer one, so the least length goes into these two.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id|email)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{3,})""", re.IGNORECASE | re.ASCII)
_SHORT_ACCESS = re.compile(r"\bAKIA[A-Z0-9]{6,13}\b")
_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,14}://[^\s"'<>]{4,}|\b(?:host(?:_?name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.:/-]{4,})""", re.IGNORECASE | re.ASCII)
_LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_BLANK = re.compile(r"\n[ \t]*\n")
#: Every text with a part matches this; the linear-time engine skips the others.
_ANY = r"(?i)(?:passw|secret|token|api_?key|akia|user|login|account|client_?id|email|://|host|endpoint|server|url)|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{20}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(BASE[k], a, b) for a, k, b in sorted(out)]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "secret") for m in _ASSIGN.finditer(text) if 6 <= len(m[2]) < 12]
    out += [(m.start(), m.end(), "secret") for m in _LONG_TOKEN.finditer(text) if _mixed(m[0])]
    out += [(m.start(), m.end(), "identifier") for r in (_IDENTIFIER, _SHORT_ACCESS) for m in r.finditer(text)]
    out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    starts = [a for _, a, _ in base]
    reach: list[int] = []
    for _, _, b in base:
        reach.append(max(b, reach[-1] if reach else 0))

    def overlaps(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i > 0 and reach[i - 1] > a

    free = {x for x in out if not overlaps(x[0], x[1])}
    return _disjoint(free)


def _disjoint(spans: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans by start, without those that overlap a longer one (then an earlier one, then a kind listed before)."""
    points = {p: i for i, p in enumerate(sorted({p for a, b, _ in spans for p in (a, b - 1)}))}
    taken = bytearray(len(points))  # of places where spans begin or end; each is taken once
    kept: list[tuple[int, int, str]] = []
    for x in sorted(spans, key=lambda s: (s[0] - s[1], s[0], LINKED.index(s[2]))):
        i, j = points[x[0]], points[x[1] - 1]
        if not taken[i] and not taken[j]:  # those before are as long or longer, so they would cover one of its ends
            taken[i : j + 1] = b"\1" * (j + 1 - i)
            kept.append(x)
    return sorted(kept)


def linked_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates with a complementary part near by in the same scope."""
    weak = _candidates(text, base)
    if not weak:
        return []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    # access ids are identifiers and secrets' partners; assign and hex are secrets
    parts = [(a, b, k == "secret", True) for a, b, k in weak] + [(a, b, k != "access", False) for k, a, b in base]
    found = set()
    for secrets, others in (([p for p in parts if p[2]], [p for p in parts if not p[2]]), ([p for p in parts if not p[2]], [p for p in parts if p[2]])):
        # the nearest part that starts at or before, by its end, and the next that starts after
        others.sort()
        starts = [o[0] for o in others]
        scope = [bisect.bisect_right(breaks, o[0]) for o in others]
        furthest: list[int] = []
        for i, o in enumerate(others):
            same = furthest and scope[i] == scope[i - 1]
            furthest.append(max(o[1], furthest[-1]) if same else o[1])
        for a, b, _, is_weak in secrets:
            if not is_weak:
                continue
            own = bisect.bisect_right(breaks, a)
            i = bisect.bisect_right(starts, a)
            before = i > 0 and scope[i - 1] == own and a - furthest[i - 1] <= REACH
            after = i < len(others) and scope[i] == own and starts[i] - b <= REACH
            if before or after:
                found.add((a, b))
    return [(k, a, b) for a, b, k in weak if (a, b) in found]


def all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    order = {k: i for i, k in enumerate(BASE + LINKED)}
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[1], order[s[0]], s[2]))


def _flagged(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts, _ANY).to_pylist()


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanned(batches):
    for batch in slices(batches):
        texts = batch.column("text")
        found = [all_spans(t) if hit else ([], []) for t, hit in zip(texts.to_pylist(), _flagged(texts))]
        lists = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[i]] for f in found], _SPAN) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *lists], names=["doc_id", "base", "spans"])


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans that the patterns find) and spans (with linked ones), one row per row of ``docs``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        _scanned, f"doc_id long, base {_SPANS}, spans {_SPANS}"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of what ``scan`` returns."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or overlapping run of spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span masked in ``text``; other columns, and texts without secrets, stay. n_chars follows the text where there is such a column."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, at):
            texts = pc.fill_null(batch.column(at), "")
            if any(hits := _flagged(texts)):
                old = batch.column(at).to_pylist()
                new = [masked(t, all_spans(t)[1]) if hit else t for t, hit in zip(old, hits)]
                columns = [pa.array(new, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
