"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has eight bytes.  Two that differ in at most two bits share the
bytes of at least six positions.  Counting shared postings of single bytes would pair a
256th of all documents with each other; the count is therefore taken inside the
index: a posting is kept for every six positions with their bytes (28 a
fingerprint).  A pair meets in 1, 7 or 28 of these lists if it shares 6, 7 or 8
bytes and in none below, so meeting at all is the guaranteed minimum of matches.
A list holds distinct fingerprints that differ in their other 16 bits only, hence
65,536 at the most whatever the input, and is verified by looking up the
137 patterns of up to two bits, not by pairs.

Links of a list are cut down to a spanning forest there; components then come from
rounds of joins.  Exact copies cost one fingerprint.  Null and empty texts have
fingerprint zero and are linked like any other.  Repeated rows stay; a null doc_id is
never the smallest one, and a component of null ids only has a null id.
An empty table gives no rows; other columns are kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import by_bytes, materialize, texts_of, whole_row
from ticketloom.llm.graph import components

SHINGLE = 3
BITS = 2
KEPT = 6  # bytes that two fingerprints within BITS share at least
_NIBBLES = np.array([[(v >> i) & 1 for i in range(8)] for v in range(256)], np.uint8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles (bytes.lower and bytes.split know ASCII only, as wanted)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    stops = ends[len(words) - n :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # 64 counters at a time, in bounded memory
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, th, fp`` (64 bits as long; th: hash of the text), one row per row of ``docs``."""
    by_bytes(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(fp, pa.int64())], ["doc_id", "th", "fp"]
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long"
    text = F.col("text").cast("string").cast("binary")
    return docs.select("doc_id", F.xxhash64("text").alias("th"), text.alias("text")).mapInArrow(run, schema)


def _postings(fp: str):
    """The lists of a fingerprint: ``place`` (which positions are left out) and ``rest`` with these bytes blank."""
    blanks = [(255 << (8 * i)) | (255 << (8 * j)) for i, j in combinations(range(8), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in blanks]
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(k).cast("tinyint").alias("place"), F.col(fp).bitwiseAND(F.lit(~m).cast("long")).alias("rest"))
                for k, m in enumerate(signed)
            ]
        )
    )


_PLACES = list(combinations(range(8), 8 - KEPT))
_NEAR = [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]


def _sixteen(fp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The two bytes that a list leaves open, as one number."""
    at = np.array(_PLACES, np.uint64) * np.uint64(8)
    u = fp.view(np.uint64)
    low, high = (u >> at[place, 0]) & np.uint64(255), (u >> at[place, 1]) & np.uint64(255)
    return (low | (high << np.uint64(8))).astype(np.int64)


def _forest(open_bytes: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, smaller member) that span the components within one list."""
    at = np.full(65_536, -1, np.int64)
    at[open_bytes] = np.arange(len(fps))
    pairs = []
    if len(fps) < 64:
        i, j = np.triu_indices(len(fps), 1)
        x = open_bytes[i] ^ open_bytes[j]
        near = np.bitwise_count(x) <= BITS
        pairs = [(i[near], j[near])]
    else:
        for mask in _NEAR:
            j = at[open_bytes ^ mask]
            i = np.flatnonzero(j >= 0)
            keep = j[i] > i
            pairs.append((i[keep], j[i][keep]))
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(np.concatenate([p[0] for p in pairs]).tolist(), np.concatenate([p[1] for p in pairs]).tolist()):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(fps[i]), int(fps[j])))
    return out


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: fingerprints within two bits, as a spanning forest of every list of the index."""
    posted = distinct.select("fp", _postings("fp").alias("p")).select("p.place", "p.rest", "fp")
    sorted_ = posted.repartition("place", "rest").sortWithinPartitions("place", "rest", "fp")

    def lists(place, rest, fp, last):
        """Whole lists out of sorted rows; the rows of the last one are held back unless it is over."""
        cut = np.flatnonzero((place[1:] != place[:-1]) | (rest[1:] != rest[:-1])) + 1
        edges = np.concatenate(([0], cut, [len(place)]))
        whole = len(edges) - 1 - (not last)
        many = np.flatnonzero(np.diff(edges[: whole + 1]) > 1)
        out = []
        for k in many.tolist():
            s = slice(edges[k], edges[k + 1])
            out += _forest(_sixteen(fp[s], place[s]), fp[s])
        return out, edges[whole] if not last else len(place)

    def run(batches):
        held = [np.empty(0, t) for t in (np.int8, np.int64, np.int64)]
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("place", "rest", "fp")]
            place, rest, fp = (np.concatenate(x) for x in zip(held, new))
            if len(place):
                out, done = lists(place, rest, fp, False)
                held = [x[done:].copy() for x in (place, rest, fp)]
                yield _pairs(out)
        if len(held[0]):
            yield _pairs(lists(*held, True)[0])

    return sorted_.mapInArrow(run, "a long, b long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, th, fp, root, component_id``, one row per row of ``docs``.

    root: the component's smallest fingerprint; component_id: the smallest doc_id reachable.
    """
    marked = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component, with all columns.

    The one with the smallest doc_id stays; null ids come last, equal ids are ordered by a hash
    of the text, and of rows repeated in both any one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    keep = near_duplicates(docs, shingle).groupBy("root").agg(F.min(rank).alias("m"))
    keys = keep.select(F.struct(F.col("m.doc_id").alias("d"), F.col("m.th").alias("t")).alias("_k"))
    rows = docs.select(
        F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias("_k"), whole_row(docs).alias("_row")
    )
    return rows.join(keys, "_k").dropDuplicates(["_k"]).select("_row.*")
