"""Exact repeats of long byte strings, by anchors and hash-compared suffix sorts.

Removed is every byte that a string of ``length`` bytes covers which also starts anywhere else in
the corpus, the same text included.

1. Anchors.  Among the k-grams of every window of ``length`` bytes the one of the smallest hash
   (leftmost of equals) is its anchor.  Equal windows have equal anchors at the same place in them, so
   windows need comparing only within an anchor.  Neighbouring windows share anchors: a text falls into
   segments, some 75 windows each, of one anchor.
2. Whole segments.  Segments of one anchor with one digest, if there are two, are repeated as they are.
3. Ends of repeats.  Where an anchor has different segments, one of each comes with its bytes.  The windows of a
   segment are suffixes of it; they are sorted in a mergesort whose comparisons find the common
   extension by binary search over prefix polynomial hashes, 8 steps for 200 bytes.  Neighbours that share ``length``
   bytes are repeats; their bytes are compared, so no hash decides alone.
   An anchor of more than ``GROUP`` different segments is dealt over several groups, and the windows left over
   there meet in a join on their digests.
4. Intervals are merged within stretches of a text, so that a row never holds one for each byte; then they meet
   their texts, which are cut.

Equal segments are told by anchor and digest, 40 and 64 bits of different hashes: of n segments, two different ones are taken
for repeats with a probability of about n^2 / 2^105.  Everything else is compared byte by byte.

Matches never cross texts.  Null is empty.  An empty table gives no rows.  Columns other than doc_id and text are not
looked at, whatever their names.  Repeated rows are texts of their own, hence repeats of each
other.  Texts shorter than ``length`` stay whole.  Texts travel compressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import materialize, texts_of

LENGTH = 200
GRAM = 40
GROUP = 5_000
HELD = 1 << 18  # bytes of segments that are compared at a time, but for a larger group; some 100 times that in numbers
BATCH = 2 << 20  # bytes of rows that come to Python at a time
GIVEN = 4 << 20  # bytes of unpacked text that are given out at a time, but for a longer text
STRETCH = 1 << 16  # places of a text whose intervals are merged together
BLOCK = 1 << 20  # windows of a long text at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power: hash of [i, j) is (s[j] - s[i]) * base^-i."""
    up, _ = Powers.to(len(data))
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=s[1:])
    return s


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``anchor, place, first, last``: hash and place of each anchor, and the windows that it stands for."""
    parts = []
    for at in range(0, len(data) - length + 1, BLOCK):
        own = data[at : at + BLOCK + length - 1]
        s = prefixes(own)
        h = (s[gram:] - s[:-gram]) * Powers.to(len(own))[1][: len(own) - gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        packed = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        width, m = length - gram + 1, packed
        done = 1
        while done < width:  # least of `width` values in a row, by doubling
            step = min(done, width - done)
            m = np.minimum(m[:-step], m[step:])
            done += step
        place = (m & _POSITION).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut - 1, [len(place) - 1]))
        where = place[first]
        parts.append((h[where].view(np.int64), where + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.empty(0, np.int64) for _ in range(4))


def _lists(batches, length: int):
    """Segments of the texts of a batch as rows."""
    names = ("d", "t", "anchor", "digest", "place", "first", "last")
    for b in batches:
        texts = texts_of(b.column("text"))
        doc, t = b.column("d"), b.column("t")
        rows, held = [], 0
        for i, text in enumerate([*texts, None]):
            if text is not None and len(text) >= length:
                anchor, place, first, last = segments(np.frombuffer(text, np.uint8), length)
                view = memoryview(text)
                digest = [
                    xxhash.xxh3_64_intdigest(view[f : z + length], p - f)
                    for p, f, z in zip(place.tolist(), first.tolist(), last.tolist())
                ]
                rows.append((np.full(len(anchor), i), anchor, np.array(digest, np.uint64).view(np.int64), place, first, last))
                held += len(anchor)
            if rows and (text is None or held > 100_000):
                owner, *columns = (np.concatenate(c) for c in zip(*rows))
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([doc.take(owner), t.take(owner), *map(pa.array, columns)], list(names))
                rows, held = [], 0


# ---- suffix sort -----------------------------------------------------------------------------


class Suffixes:
    """Bounded suffixes of a buffer, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth, self.s = data, depth, prefixes(data)
        self.inverse = Powers.to(len(data) + 1)[1]

    def same(self, u: np.ndarray, v: np.ndarray, n) -> np.ndarray:
        """Whether the first n bytes agree, by their hashes."""
        return (self.s[u + n] - self.s[u]) * self.inverse[u] == (self.s[v + n] - self.s[v]) * self.inverse[v]

    def common(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Length of the common beginnings, up to the depth, by binary search."""
        lo, hi = np.zeros(len(u), np.int64), np.full(len(u), self.depth, np.int64)
        for _ in range(self.depth.bit_length()):
            mid = (lo + hi + 1) >> 1
            ok = self.same(u, v, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def less(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        n = self.common(u, v)
        at = np.minimum(n, self.depth - 1)
        return (n < self.depth) & (self.data[u + at] < self.data[v + at])

    def sort(self, group: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Order of the suffixes by group, then content: a stable bottom-up mergesort over all groups at once.

        With the groups in order, two runs interleave only in the group that lies over their border.
        """
        order = np.argsort(group, kind="stable")
        g = group[order]
        n = len(g)
        edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        of = np.repeat(np.arange(len(edges)), np.diff(np.concatenate((edges, [n]))))
        begin, end = edges[of], np.concatenate((edges[1:], [n]))[of]
        width = 1
        while width < n:
            border = np.arange(width, n, 2 * width)
            border = border[g[border - 1] == g[border]]
            lo = np.maximum(border - width, begin[border])
            hi = np.minimum(border + width, end[border])
            if len(border):
                sizes = hi - lo
                base = np.repeat(np.arange(len(border)), sizes)
                at = np.arange(len(base)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[base]
                left = at < border[base]
                # the place of each element among those of the other run
                a = np.where(left, border[base], lo[base])
                z = np.where(left, hi[base], border[base])
                own = start[order[at]]
                while (open_ := np.flatnonzero(a < z)).size:
                    mid = (a[open_] + z[open_]) >> 1
                    other, mine, is_left = start[order[mid]], own[open_], left[open_]
                    # left elements stand before equal right ones
                    goes = np.empty(len(open_), bool)
                    goes[is_left] = self.less(other[is_left], mine[is_left])
                    goes[~is_left] = ~self.less(mine[~is_left], other[~is_left])
                    a[open_] = np.where(goes, mid + 1, a[open_])
                    z[open_] = np.where(goes, z[open_], mid)
                rank = np.where(left, at - lo[base] + a - border[base], at - border[base] + a - lo[base])
                new = order.copy()
                new[lo[base] + rank] = order[at]
                order = new
            width *= 2
        return order

    def equal(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the suffixes agree to the depth: hashes, then the bytes."""
        out = self.same(u, v, self.depth)
        some = np.flatnonzero(out)
        reach = np.arange(self.depth)
        for at in range(0, len(some), 4096):
            k = some[at : at + 4096]
            out[k] = (self.data[u[k][:, None] + reach] == self.data[v[k][:, None] + reach]).all(axis=1)
        return out


def repeats(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows (group, start) of a buffer: whether an equal one is in the group, and its class's number."""
    suffixes = Suffixes(data, length)
    order = suffixes.sort(group, start)
    near = np.zeros(len(order) + 1, bool)
    together = group[order][1:] == group[order][:-1]
    pairs = np.flatnonzero(together) + 1
    near[pairs] = suffixes.equal(start[order[pairs - 1]], start[order[pairs]])
    met, number = np.empty(len(order), bool), np.empty(len(order), np.int64)
    met[order] = near[:-1] | near[1:]
    number[order] = np.cumsum(~near[:-1])
    return met, number


OUT = "kind int, d {id}, t long, x long, y long, d1 long, d2 long"


def _compare(length: int, kind: str):
    """Windows of the spans of each group that are repeated in it; and, of dealt groups, digests of the windows."""

    def solve(rows: pa.Table):
        anchor, part, parts = (rows.column(c).to_numpy() for c in ("anchor", "part", "parts"))
        place, first, last, alone = (rows.column(c).to_numpy() for c in ("place", "first", "last", "alone"))
        spans = texts_of(rows.column("span"))
        data = np.frombuffer(b"".join(spans), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(s) for s in spans])))[:-1]
        n = last - first + 1
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
        # equal windows have the anchor at one place in them
        group = (np.cumsum(new)[row] - 1) * (length + 1) + (place - first)[row] - j
        met, number = repeats(data, group, base[row] + j, length)
        hit = np.flatnonzero(met & alone[row])
        if len(hit):
            cut = np.flatnonzero((np.diff(row[hit]) != 0) | (np.diff(j[hit]) != 1)) + 1
            a, z = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(hit) - 1]))
            owner = row[hit[a]]
            x, y = first[owner] + j[hit[a]], first[owner] + j[hit[z]] + length
            yield _out(rows, owner, 0, x, y, None)
        dealt = np.flatnonzero(parts[row] > 1)
        if len(dealt):
            _, lead = np.unique(number[dealt], return_index=True)
            lead = dealt[lead]
            view = memoryview(data)
            for at in range(0, len(lead), 50_000):
                k = lead[at : at + 50_000]
                s = base[row[k]] + j[k]
                digest = [xxhash.xxh3_128_digest(view[i : i + length]) for i in s.tolist()]
                # 1: still to be met elsewhere; 2: met already, but a partner for others
                state = np.where(met[k] | ~alone[row[k]], 2, 1)
                yield _out(rows, row[k], state, first[row[k]] + j[k], first[row[k]] + j[k] + length, digest)

    def _out(rows, owner, state, x, y, digest):
        d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2) if digest else np.zeros((len(owner), 2), np.int64)
        at = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.broadcast_to(np.int32(state), len(owner)) if np.isscalar(state) else state.astype(np.int32), pa.int32()),
                rows.column("d").combine_chunks().take(at), rows.column("t").combine_chunks().take(at),
                pa.array(x), pa.array(y), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()),
            ],
            ["kind", "d", "t", "x", "y", "d1", "d2"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            del b
            if size < HELD:
                continue
            rows = pa.Table.from_batches(held)
            anchor, part = rows.column("anchor").to_numpy(), rows.column("part").to_numpy()
            other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
            whole = other[-1] + 1 if len(other) else 0
            if whole:
                yield from solve(rows.slice(0, whole).combine_chunks())
            rest = rows.slice(whole).combine_chunks()
            held = rest.to_batches()
            del rows, anchor, part, other
            pa.default_memory_pool().release_unused()
            size = rest.num_rows * 300 if whole else 0
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def removed(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``k, x, y``: intervals of bytes to remove (they may overlap); k is ``struct(doc_id, hash of the text)``."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), text.alias("text"))
    schema = f"d {kind}, t long, anchor long, digest long, place long, first long, last long"
    ints = [F.col(c).cast("int").alias(c) for c in ("place", "first", "last")]
    listed = own.mapInArrow(lambda b: _lists(b, length), schema).select("d", "t", "anchor", "digest", *ints)
    listed = materialize(listed, "all-segments")
    # anchors of one place only end here
    often = listed.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    often = materialize(often, "anchors")
    met = materialize(listed.join(often, "anchor"), "segments")
    one = F.struct("d", "t", "place", "first", "last")
    kinds = materialize(
        met.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min(one).alias("one")), "segment-kinds"
    )
    whole = met.join(kinds.filter("c > 1").select("anchor", "digest"), ["anchor", "digest"]).select(
        "d", "t", F.col("first").cast("long").alias("x"), (F.col("last") + length).cast("long").alias("y")
    )
    # written by itself, so that the join's other side can be split where an anchor is frequent
    differ = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "split-anchors")
    parts = F.ceil(F.col("m") / group).cast("int")
    need = kinds.join(differ, "anchor").select(
        "anchor", parts.alias("parts"), F.pmod(F.xxhash64("digest"), parts).cast("int").alias("part"), (F.col("c") == 1).alias("alone"), "one.*"
    )
    wanted = need.groupBy(F.struct("d", "t").alias("k")).agg(
        F.collect_list(F.struct("anchor", "part", "parts", "alone", "place", "first", "last")).alias("cuts")
    )
    spans = packed(docs).dropDuplicates(["k"]).join(wanted, "k").select(
        F.col("k.d").alias("d"), F.col("k.t").alias("t"), "packed", "cuts"
    ).mapInArrow(lambda b: _spans(b, length), _span_schema(kind))
    compared = materialize(
        spans.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_compare(length, kind), OUT.format(id=kind)),
        "compared",
    )
    apart = compared.filter("kind > 0")
    shared = apart.groupBy("d1", "d2").agg(F.count("*").alias("c")).filter("c > 1").select("d1", "d2")
    across = apart.filter("kind = 1").join(shared, ["d1", "d2"]).select("d", "t", "x", "y")
    found = whole.union(compared.filter("kind = 0").select("d", "t", "x", "y")).union(across)
    return found.select(F.struct("d", "t").alias("k"), "x", "y")


def packed(docs: DataFrame) -> DataFrame:
    """``k, packed``: texts as compressed bytes, so that a shuffle of them moves less."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = pa.array([zip_.compress(t) for t in texts_of(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), data], ["d", "t", "packed"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), text)
    return rows.mapInArrow(run, f"d {kind}, t long, packed binary").select(F.struct("d", "t").alias("k"), "packed")


def _span_schema(kind: str) -> str:
    return f"anchor long, part int, parts int, alone boolean, place int, first int, last int, d {kind}, t long, span binary"


def _spans(batches, length: int):
    """The bytes of the wanted segments."""
    names = ("anchor", "part", "parts", "alone", "place", "first", "last")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
    zip_ = zstandard.ZstdDecompressor()
    for b in batches:
        for i, (data, cuts) in enumerate(zip(b.column("packed").to_pylist(), b.column("cuts").to_pylist())):
            text = zip_.decompress(data)
            for at in range(0, len(cuts), 10_000):
                some = cuts[at : at + 10_000]
                columns = [pa.array([c[n] for c in some], k) for n, k in zip(names, kinds)]
                owner = pa.array(np.full(len(some), i))
                span = pa.array([text[c["first"] : c["last"] + length] for c in some], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*columns, b.column("d").take(owner), b.column("t").take(owner), span], [*names, "d", "t", "span"]
                )


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of intervals that touch or overlap."""
    out: list[list[int]] = []
    for x, y in sorted(cuts):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _merged(cuts: str):
    """Sorted intervals with those that touch or overlap made one."""
    kind = "array<struct<x:bigint,y:bigint>>"

    def add(out, c):
        last = F.element_at(out, -1)
        apart = (F.size(out) == 0) | (c["x"] > F.try_element_at(out, F.lit(-1))["y"])
        longer = F.struct(last["x"].alias("x"), F.greatest(last["y"], c["y"]).alias("y"))
        return F.when(apart, F.concat(out, F.array(c))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer)))

    return F.aggregate(cuts, F.array().cast(kind), add)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed runs and remaining bytes, one row per row of ``docs``."""
    found = removed(docs, length).withColumn("s", F.floor(F.col("x") / STRETCH))
    near = found.groupBy("k", "s").agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("cuts"))
    intervals = near.select("k", _merged("cuts").alias("cuts")).groupBy("k").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        zip_ = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def given(out):
            ids, n, spans, kept = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column("doc_id").type), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):  # one text is unpacked at a time
                text, cuts = zip_.decompress(b.column("packed")[i].as_py()), b.column("cuts")[i].as_py()
                runs = merged([(c["x"], c["y"]) for c in cuts or ()])
                edges = [0, *[e for r in runs for e in r], len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                out.append((b.column("doc_id")[i].as_py(), len(text), [{"start": x, "end": y} for x, y in runs], kept))
                held += len(kept)
                if held > GIVEN:
                    yield given(out)
                    out, held = [], 0
            if out:
                yield given(out)

    rows = packed(docs).join(intervals, "k", "left").select(F.col("k.d").alias("doc_id"), "packed", "cuts")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """Numbers and digest of :func:`deduplicated`'s rows."""
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
