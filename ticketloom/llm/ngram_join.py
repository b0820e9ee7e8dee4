"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersections.

A text's set holds its distinct word shingles as 64-bit hashes.  Two sets link if
100 * intersection >= share * union.  No link is lost; the only chance is in the hashes
(two sets of s shingles are misjudged with a probability of about s^2 / 2^64, equal digests of 128 bits are taken for equal sets).

1. Sets.  Equal sets are one class.  Shingles are ordered by how often their slot of a fixed table of
   counts over all texts is used, then by hash, so that what many texts share comes last; linked sets
   then share one of their first ``n - ceil(share * n / 100) + 1`` shingles.
2. Tiles.  Sizes fall into bands such that linked sets lie in one band or in neighbouring ones.  A tile is one shingle
   and one band: the band's sets that start with it (residents), and those of the next band (guests).  Shingles
   with the same members make one tile.  Tiles beyond ``TILE`` sets are dealt into blocks, of which each two meet.
3. Bitmaps.  Every set sets bits by its hashes, by parity; w bits that differ between two sets mean at least w
   elements in one only, so the count bounds the overlap from above.  In a tile, a search from set to set among
   those not yet reached gives a spanning forest of the pairs that the bound allows, not all pairs.  It starts from
   the smallest number, so that tiles with much the same members give much the same pairs.
4. Intersections.  The pairs of the forests are verified on the sorted sets.  Where one of them fails, the sets of the
   forest's tree meet once more, and the same search goes from component to component by verified links.

Words are runs of characters other than 0x09-0x0D and 0x20, A-Z are lower-cased.  Fewer words than a shingle has: all of
them are the only shingle.  None, or a null text: the set is empty and linked with nothing.  Repeated rows are members of one
class.  A null doc_id is never the smallest one; a component of null ids only has a null id.  An empty table gives no rows.
Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.llm.common import by_bytes, materialize, texts_of
from ticketloom.llm.graph import components

SHINGLE = 4
SHARE = 85
TILE = 2048  # sets of a tile
TILE_BYTES = 64 << 20  # of hashes, if all its sets came together
SLOT_BITS = 20
CHUNKS = 64
WIDEST = 1 << 14  # bits of a bitmap
REMEMBERED = 1 << 18  # words
PIECE = 1 << 20  # bytes of a text that are split at a time
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


class _Hashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.hashes = size, _Hashes()

    def words(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            border = _SPACE.search(text, at + PIECE)
            to = border.start() if border else len(text)
            own = text[at:to].lower().split()
            parts.append(np.fromiter(map(self.hashes.__getitem__, own), np.uint64, len(own)))
            if len(self.hashes) > REMEMBERED:
                self.hashes.clear()
            at = to
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def set(self, text: bytes) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        k = min(self.size, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * _FACTOR + h[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(out ^ (out >> np.uint64(29)))


def bands(share: int) -> np.ndarray:
    """Least size of each band: a set links at the most into the next band."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(out[-1] * 100 // share + 1)
    return np.array(out, np.int64)


def bitmap(hashes: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of at least ``width`` bytes as rows of 64-bit numbers; wider ones are folded by parity."""
    out = np.empty((len(rows), width), np.uint8)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    for n in np.unique(lengths).tolist():
        some = np.flatnonzero(lengths == n)
        wide = np.frombuffer(b"".join([rows[i] for i in some.tolist()]), np.uint8).reshape(len(some), n // width, width)
        out[some] = np.bitwise_xor.reduce(wide, axis=1)
    return out.view(np.uint64)


def _allowed(n: np.ndarray, m: np.ndarray, differ: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of n and m elements can link if at least ``differ`` elements are in one only."""
    overlap = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return overlap * 100 >= share * (n + m - overlap)


def slot_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each slot of shingle hashes, how far its use lies above the mean, as a power of two: a megabyte at any input."""
    slots = 1 << SLOT_BITS
    per = slots // CHUNKS

    def rows(counts):
        data = [counts[i * per : (i + 1) * per].astype("<i8").tobytes() for i in range(CHUNKS)]
        return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(data, pa.binary())], ["chunk", "counts"])

    def count(batches):
        shingler, counts, held = Shingler(size), np.zeros(slots, np.int64), []
        for b in batches:
            for text in texts_of(b.column("text")):
                held.append((shingler.set(text) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
                if sum(map(len, held[-64:])) > slots or len(held) > 2000:
                    counts += np.bincount(np.concatenate(held), minlength=slots)
                    held = []
        if held:
            counts += np.bincount(np.concatenate(held), minlength=slots)
        yield rows(counts)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, "<i8")
        data = [s.tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    found = docs.select(_text(docs)).mapInArrow(count, schema).repartition(CHUNKS // 4, "chunk").mapInArrow(add, schema).collect()
    counts = np.zeros(slots, np.int64)
    for r in found:
        counts[r.chunk * per : (r.chunk + 1) * per] = np.frombuffer(r.counts, "<i8")
    usual = 2 * counts.mean() + 16
    return np.ceil(np.log2(np.maximum(counts / usual, 1))).astype(np.uint8)


def _text(docs: DataFrame):
    return F.col("text").cast("string").cast("binary").alias("text")


def marked(docs: DataFrame, size: int, share: int) -> DataFrame:
    """``doc_id, th, n, band, digest, prefix, bits`` of each row; ``digest`` is null for empty sets."""
    by_bytes(docs.sparkSession)
    level, edges = slot_levels(docs, size), bands(share)
    names = ["doc_id", "th", "n", "band", "digest", "prefix", "bits"]

    def run(batches):
        shingler = Shingler(size)
        for b in batches:
            out, prefixes = [], []
            for text in texts_of(b.column("text")):
                s = shingler.set(text)
                n = len(s)
                if not n:
                    out.append((0, 0, None, None))
                    prefixes.append(np.empty(0, np.int64))
                    continue
                band = int(np.searchsorted(edges, n, side="right")) - 1
                bits = min(WIDEST, max(64, 1 << int(edges[band + 1] - 1).bit_length()))
                first = n - (share * n + 99) // 100 + 1
                rare = level[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                prefixes.append((s[np.argsort(rare, kind="stable")[:first]] if rare.any() else s[:first]).view(np.int64))
                out.append((n, band, xxhash.xxh3_128_digest(s.tobytes()), bitmap(s, bits)))
            n, band, digest, bits = zip(*out) if out else [()] * 4
            offsets = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *prefixes]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(band, pa.int32()),
                    pa.array(digest, pa.binary()), lists, pa.array(bits, pa.binary()),
                ],
                names,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, th long, n long, band int, digest binary, prefix array<long>, bits binary"
    return docs.select("doc_id", F.xxhash64("text").alias("th"), _text(docs)).mapInArrow(run, schema)


def tiles(classes: DataFrame, share: int) -> DataFrame:
    """``key, band, lo, hi, guest, side, cid``: the sets of each tile."""
    posted = classes.select("cid", F.col("band").alias("own"), F.explode("prefix").alias("key"))
    # shingles of one set only go no further; of the others, two sums of hashes stand for a list of members
    shared = posted.withColumn("c", F.count("*").over(W.partitionBy("key"))).filter("c > 1").drop("c")
    shared = materialize(shared, "shared")
    sign = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"x{i}") for i in (1, 2)]
    once = shared.groupBy("key").agg(F.count("*").alias("c"), *sign).groupBy("c", "x1", "x2").agg(F.min("key").alias("key"))
    met = materialize(shared.join(once.select("key"), "key").select("key", "own", "cid"), "met")
    # by band, its residents and guests: what is alone in its tile goes no further
    held = met.groupBy("key", "own").agg(F.count("*").alias("c"))
    in_turn = W.partitionBy("key").orderBy("own")
    next_ = F.when(F.lead("own").over(in_turn) == F.col("own") + 1, F.lead("c").over(in_turn)).otherwise(F.lit(0))
    sizes = held.select("key", F.col("own").alias("band"), (F.col("c") + next_).alias("c")).filter("c > 1")
    edges = bands(share)
    most = [max(1, min(TILE, TILE_BYTES // (8 * int(e)))) for e in edges[1:]]
    limit = F.coalesce(F.get(F.array(*map(F.lit, most)), F.col("band")), F.lit(1))
    sizes = materialize(sizes.select("key", "band", F.ceil(F.col("c") / limit).cast("int").alias("blocks")), "tile-sizes")
    role = F.explode(
        F.array(
            F.struct(F.col("own").alias("band"), F.lit(False).alias("guest")), F.struct((F.col("own") - 1).alias("band"), F.lit(True).alias("guest"))
        )
    )
    dealt = met.select("key", "cid", role.alias("r")).select("key", "cid", "r.*").join(sizes, ["key", "band"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select("key", "band", lo.alias("lo"), hi.alias("hi"), "guest", (F.col("block") == hi).alias("side"), "cid")


def forest(bits: np.ndarray, n: np.ndarray, guest: np.ndarray, side: np.ndarray, across: bool, share: int) -> list[tuple[int, int, int]]:
    """``(root, x, y)``: a spanning forest of the allowed pairs, guests not with guests and, if ``across``, sides only with the other one."""
    left, out = np.arange(len(n)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        reached = [root]
        while reached and len(left):
            x = reached.pop()
            may = (100 * np.minimum(n[left], n[x]) >= share * np.maximum(n[left], n[x])) & ~(guest[left] & guest[x])
            if across:
                may &= side[left] != side[x]
            at = np.flatnonzero(may)
            if not len(at):
                continue
            y = left[at]
            ok = _allowed(n[y], n[x], np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64), share)
            if ok.any():
                found = y[ok].tolist()
                out += [(root, x, j) for j in found]
                reached += found
                left = np.delete(left, at[ok])
    return out


def _by_tile(keys: list[str], solve):
    """Arrow function over sorted rows: ``solve(arrays, starts)`` for whole groups; the last group waits for its end."""

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            key = np.column_stack([rows.column(k).to_numpy() for k in keys])
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
            whole = int(starts[-1])
            if whole:
                yield from solve(rows.slice(0, whole).combine_chunks(), starts)
            held = rows.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from solve(held, np.array([0, held.num_rows]))

    return run


TREE = ["key", "band", "lo", "hi", "root", "a", "b"]


def trees(members: DataFrame, share: int) -> DataFrame:
    """``key, band, lo, hi, root, a, b``: spanning forests of each tile's allowed pairs."""
    keys = ["key", "band", "lo", "hi"]

    def solve(rows, starts):
        cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
        guest, side = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("guest", "side"))
        lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
        bits = rows.column("bits").to_pylist()
        size = np.diff(starts)
        out = [np.empty((0, 4), np.int64)]  # first row of the tile, root, x, y
        two = starts[:-1][size == 2]
        two = two[~(guest[two] & guest[two + 1]) & ((lo[two] == hi[two]) | (side[two] != side[two + 1]))]
        if len(two):
            wide = np.array([(len(bits[i]), len(bits[i + 1])) for i in two.tolist()]).min(axis=1)
            for w in np.unique(wide).tolist():
                i = two[wide == w]
                x, y = (_folded([bits[k] for k in (i + d).tolist()], w) for d in (0, 1))
                ok = _allowed(n[i], n[i + 1], np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), share)
                i = i[ok]
                out.append(np.column_stack((i, i, i, i + 1)))
        for k in np.flatnonzero(size > 2).tolist():
            s = slice(int(starts[k]), int(starts[k + 1]))
            if guest[s].all():
                continue
            own = _folded(bits[s], min(map(len, bits[s])))
            if found := forest(own, n[s], guest[s], side[s], bool(lo[s.start] != hi[s.start]), share):
                x = np.array(found, np.int64) + s.start
                out.append(np.column_stack((np.full(len(x), s.start), x)))
        at, root, x, y = np.concatenate(out).T
        a, b = np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])
        columns = [rows.column(k).to_numpy()[at] for k in keys] + [cid[root], a, b]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], TREE)

    run = _by_tile(keys, solve)
    return members.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(
        run, "key long, band int, lo int, hi int, root long, a long, b long"
    )


def _shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Elements that a sorted set has in common with each of some others."""
    at = np.searchsorted(one, flat := np.concatenate(many))
    hit = one[np.minimum(at, len(one) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, many[:-1])]))


def joined(bits: np.ndarray, sets: list[np.ndarray], label: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links that join different labels, as many as it takes to join all that can be joined."""
    n = np.array([len(s) for s in sets], np.int64)
    left, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        reached = np.flatnonzero(label == label[first]).tolist()
        left[reached] = False
        while reached and left.any():
            x = reached.pop()
            y = np.flatnonzero(left & (100 * np.minimum(n, n[x]) >= share * np.maximum(n, n[x])))
            y = y[_allowed(n[y], n[x], np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64), share)]
            for at in range(0, len(y), 256):
                some = y[at : at + 256]
                some = some[left[some]]
                if not len(some):
                    continue
                both = _shared(sets[x], [sets[i] for i in some.tolist()])
                for i in some[100 * both >= share * (n[some] + n[x] - both)].tolist():
                    if left[i]:
                        out.append((x, i))
                        new = np.flatnonzero(left & (label == label[i]))
                        left[new] = False
                        reached += new.tolist()
    return out


def remaining(members: DataFrame, share: int) -> DataFrame:
    """``a, b``: links between different labels of each tree's sets, from their intersections."""

    def solve(rows, starts):
        cid, label, out = rows.column("cid").to_numpy(), rows.column("label").to_numpy(), []
        for s in (slice(int(x), int(y)) for x, y in zip(starts[:-1], starts[1:])):
            if (label[s] == label[s.start]).all():
                continue
            own = rows.slice(s.start, s.stop - s.start)
            bits = own.column("bits").to_pylist()
            sets = [np.frombuffer(h, np.uint64) for h in own.column("hashes").to_pylist()]
            out += [(x + s.start, y + s.start) for x, y in joined(_folded(bits, min(map(len, bits))), sets, label[s], share)]
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y]))], ["a", "b"])

    keys = ["key", "band", "lo", "hi", "root"]
    return members.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(_by_tile(keys, solve), "a long, b long").distinct()


def sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``cid, hashes``: the sorted sets of the classes in some pairs."""

    def sets(batches):
        shingler = Shingler(size)
        for b in batches:
            data = [shingler.set(t).tobytes() for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(data, pa.binary())], ["cid", "hashes"])

    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    places = wanted.join(classes.select("cid", F.col("at").alias("_at")), "cid")
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("_at"), _text(docs))
    known = rows.join(places, "_at").dropDuplicates(["cid"]).select("cid", "text").mapInArrow(sets, "cid long, hashes binary")
    return materialize(known, "sets")


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Add ``linked`` to pairs of classes, from the intersection of their sorted sets."""

    def meet(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(_shared(x, [y])[0])
                out.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    first = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
    return materialize(
        pairs.join(first, "a").join(second, "b").select("a", "b", "ha", "hb").mapInArrow(meet, "a long, b long, linked boolean"), "verified"
    )


def links(classes: DataFrame, docs: DataFrame, size: int, share: int) -> DataFrame:
    """``node, root``: components of the linked classes."""
    grown = materialize(trees(tiles(classes, share).join(classes.select("cid", "n", "bits"), "cid"), share), "trees")
    pairs = grown.select("a", "b").distinct()
    sets = sets_of(pairs, classes, docs, size)
    tried = verified(pairs, sets, share)
    found = tried.filter("linked").select("a", "b")
    roots = components(found)
    failed = tried.filter("not linked").select("a", "b")
    if not failed.limit(1).count():
        return roots
    tree = ["key", "band", "lo", "hi", "root"]
    doubtful = grown.join(failed, ["a", "b"]).select(*tree).distinct()
    members = grown.join(doubtful, tree).select(*tree, F.explode(F.array("a", "b")).alias("cid")).distinct()
    members = materialize(members, "doubtful")
    sign = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"x{i}") for i in (1, 2)]
    once = members.groupBy(*tree).agg(F.count("*").alias("c"), *sign).groupBy("c", "x1", "x2").agg(F.min(F.struct(*tree)).alias("t"))
    label = roots.select(F.col("node").alias("cid"), F.col("root").alias("label"))
    again = members.join(once.select("t.*"), tree).join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    late = materialize(remaining(again.join(classes.select("cid", "bits"), "cid").join(sets, "cid"), share), "late")
    return components(found.union(late)) if late.limit(1).count() else roots


def ngram_components(docs: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """``doc_id, th, n_shingles, root, component_id``, one row per row of ``docs``.

    share: percent of the union that linked sets share at least, 1 to 99.  root: number of the component's first
    class, null for empty sets; component_id: the smallest doc_id reachable.
    """
    if not 0 < share < 100:
        raise ValueError("share must be 1 to 99")
    sets = materialize(marked(docs, size, share), "sets-marked")
    same = [F.first(c).alias(c) for c in ("n", "band", "prefix", "bits")]
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "th")).alias("at"), *same)
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = links(classes, docs, size, share)
    rooted = classes.select("cid", "digest", "first").join(roots, F.col("cid") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("root", "cid").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "root", "component_id")
    out = sets.select("doc_id", "th", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", "root", own.alias("component_id"))
