"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Every text is scanned whole, in its own row, without a shuffle.  Three base
kinds come from patterns.  Candidate strings (long runs of token characters)
are cut into character classes, and the entropy of each window of a candidate is
kept up by incremental counts: one character enters, one leaves, two terms of
the sum change.  A candidate whose highest window passes the threshold of its
class becomes a span, unless the allow list knows it or a base span covers it.

Null and empty texts have no spans, an empty table gives no rows.  Columns other than doc_id and text are not looked at,
whatever their names.  Repeated rows give repeated results.  Spans
are in code points, end exclusive, ordered by start, then kind as in ``KINDS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import by_bytes

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_base64", "entropy_upper", "entropy_lower", "entropy_mixed")

# The base patterns.  Of an assignment the match is taken first and
# its value measured after, as a failing match also uses up its characters.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Strings of high entropy that are no secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"\d{4}-\d\d-\d\d[T_-].*",  # time stamps
    r"(?i).*(example|placeholder|changeme|dummy|sample).*",
    r"[A-Za-z]+([_/-][A-Za-z]+)+",  # paths and names of plain words
)
#: Bits that the highest window of a class must pass.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.7, "entropy_upper": 3.6, "entropy_lower": 3.7, "entropy_mixed": 3.9}
#: Digits that a candidate of lower-case letters and digits has at least; fewer are numbered words.
DIGITS = 3
_CAMEL = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})+")  # names of joined words
WINDOW = 20

_MARK = bytes.maketrans(
    bytes(range(256)), bytes(b in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-" for b in range(256))
)
_RUN = b"\1" * 20


@lru_cache
def _terms(window: int) -> list[float]:
    return [0.0, *(c * log2(c) for c in range(1, window + 2))]


def highest_entropy(s: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy (bits a character) of a window of ``s``, by incremental counts."""
    window = min(window, len(s))
    if not window:
        return 0.0
    terms = _terms(window)
    counts: dict[str, int] = {}
    total = least = 0.0  # sum of c log2 c; the entropy is highest where it is least
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += terms[c + 1] - terms[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += terms[c - 1] - terms[c]
        if i == window - 1 or (i >= window and total < least):
            least = total
    return max(0.0, log2(window) - least / window)


def character_class(s: str) -> str | None:
    """The class whose threshold judges a candidate; words of one case, joined words, and numbers have none."""
    digit = any(c.isdigit() for c in s)
    upper, lower = any(c.isupper() for c in s), any(c.islower() for c in s)
    if digit and (upper or lower) and not (upper and lower) and all(c in "0123456789abcdefABCDEF" for c in s):
        return "entropy_hex"
    if digit and upper and lower:
        return "entropy_base64"
    if digit and upper:
        return "entropy_upper"
    if lower and sum(map(str.isdigit, s)) >= DIGITS:
        return "entropy_lower"
    if upper and lower and not digit and not _CAMEL.fullmatch(s):
        return "entropy_mixed"
    return None


def scan(text: str, allowed: re.Pattern, thresholds: dict[str, float], window: int) -> list[tuple[str, int, int, float]]:
    """All spans ``(kind, start, end, entropy)`` of one text, in order."""
    # cheap tests that only say where a pattern cannot match
    lowered = text.lower()
    found = []
    if any(k in lowered for k in ("passw", "secret", "token", "api")):
        found = [("assign", *m.span(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if _RUN not in text.encode("utf-8", "surrogatepass").translate(_MARK):
        return found
    found += [("access", *m.span(), 0.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), 0.0) for m in HEX.finditer(text)]
    base = list(found)
    for m in CANDIDATE.finditer(text):
        kind = character_class(s := m.group())
        if not kind or any(a < m.end() and m.start() < b for _, a, b, _ in base) or allowed.fullmatch(s):
            continue
        if (bits := highest_entropy(s, window)) >= thresholds[kind]:
            found.append((kind, *m.span(), bits))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found


def find_secrets(
    docs: DataFrame,
    allow: Iterable[str] = ALLOWED,
    thresholds: dict[str, float] | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """``doc_id, spans`` with spans ``array<struct<kind, start, end, entropy>>``, one row per row of ``docs``."""
    by_bytes(docs.sparkSession)
    rule = "|".join(f"(?:{a})" for a in allow) or r"(?!)"
    # an inline flag may only stand first
    flags = re.I if "(?i)" in rule else 0
    allowed_source = rule.replace("(?i)", "")
    limits = THRESHOLDS | (thresholds or {})
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64())]))

    def run(batches):
        allowed = re.compile(allowed_source, flags)
        for b in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "entropy"), x)) for x in scan(t, allowed, limits, window)] if t else []
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        "spans array<struct<kind:string,start:bigint,end:bigint,entropy:double>>"
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def spans_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_secrets`' spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
