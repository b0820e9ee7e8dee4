"""Token ids in wavelet matrices: one compressed file per shard, read without unpacking it.

A shard's ids are kept as bit planes, highest bit first; each plane orders the
ids by the bits above it, stably.  Counts of ones before every 512 bits
(a directory of uint32) give rank in one step, and from rank follow access
to a token, counting of an id and, by select, the places where it stands.

File: ``WVMX1``, a JSON head of fixed length (numbers and offsets of the parts),
then doc table, planes and directories as little-endian arrays.

Documents come in ascending doc_id order (null first; equal ids by text hash) over
all shards.  Null text is empty and holds the end id only.  Repeated rows are
written as often as they come.  An empty table gives no rows; columns other than doc_id and text are not looked at,
whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import by_bytes, file_system, materialize, replaced_file, running_offsets, scratch_path

MAGIC = b"WVMX1\0\0\0"
HEAD = 1024
STEP = 512  # bits between two counts of the directory
END = 2


class WaveletMatrix:
    """Bit planes with rank and select over a sequence of non-negative integers."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        a = np.ascontiguousarray(ids, np.uint32 if bits > 16 else np.uint16)
        planes, counts, zeros = [], [], []
        for b in reversed(range(bits)):
            if b == 7:
                a = a.astype(np.uint8)  # the bits above are in the planes already
            one = (a & a.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(packed)
            counts.append(cls._directory(packed))
            low = a[~one]
            zeros.append(len(low))
            a = np.concatenate((low, a[one]))
        return cls(len(ids), planes, counts, zeros)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        step = STEP // 8
        ones = np.bitwise_count(packed)
        padded = np.zeros(-(-len(ones) // step) * step, np.uint8)
        padded[: len(ones)] = ones
        sums = padded.reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate(([0], np.cumsum(sums))).astype(np.uint32)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // STEP
        at = block * STEP // 8
        part = self.planes[level][at : (i + 7) // 8]
        ones = int(np.bitwise_count(part[: i // 8 - at]).sum())
        if i % 8:
            ones += (int(part[-1]) & ((1 << (i % 8)) - 1)).bit_count()
        return int(self.counts[level][block]) + ones

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        starts = np.arange(len(self.counts[level]), dtype=np.int64) * STEP
        before = self.counts[level] if bit else starts - self.counts[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * STEP
        bits = np.unpackbits(self.planes[level][at // 8 : (at + STEP) // 8], bitorder="little")[: self.n - at]
        return at + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The i-th id."""
        value = 0
        for level, plane in enumerate(self.planes):
            bit = (int(plane[i >> 3]) >> (i & 7)) & 1
            r = self.rank1(level, i)
            i = self.zeros[level] + r if bit else i - r
            value = (value << 1) | bit
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self.rank1(level, start), self.rank1(level, stop)
            if (value >> (len(self.planes) - 1 - level)) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id stands in a range."""
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError("no such occurrence")
        i = a + k
        for level in reversed(range(len(self.planes))):
            one = (value >> (len(self.planes) - 1 - level)) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest to the highest."""
        bits = len(self.planes)
        kind = np.uint8
        a = np.zeros(self.n, kind)
        for level in reversed(range(bits)):
            if bits - 1 - level == 8:
                kind = np.uint32 if bits > 16 else np.uint16
                a = a.astype(kind)
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[~one] = a[: self.zeros[level]]
            out[one] = a[self.zeros[level] :] | kind(1 << (bits - 1 - level))
            a = out
        return a


def pack(matrix: WaveletMatrix, lengths: np.ndarray, names: list[str | None]) -> bytes:
    """The file of a shard: head, documents' lengths in ids, planes, directories, documents' names."""
    parts = [lengths.astype("<u4").tobytes()]
    parts += [p.tobytes() for p in matrix.planes] + [c.astype("<u4").tobytes() for c in matrix.counts]
    head = {"n": matrix.n, "docs": len(lengths), "bits": len(matrix.planes), "zeros": matrix.zeros}
    listed = json.dumps(names).encode()
    head["names"] = [HEAD + sum(map(len, parts)), len(listed)]
    return MAGIC + json.dumps(head).encode().ljust(HEAD - len(MAGIC)) + b"".join(parts) + listed


class ShardFile:
    """Ranges of a shard's file, read as they are needed."""

    def __init__(self, file):
        self.file = file
        head = self._read(0, HEAD)
        if not head.startswith(MAGIC):
            raise ValueError("no wavelet file")
        self.head = json.loads(head[len(MAGIC) :])
        self.n, self.docs, self.bits = self.head["n"], self.head["docs"], self.head["bits"]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the wavelet file ends too early")
        return data

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._read(HEAD, 4 * self.docs), "<u4").astype(np.int64)

    def names(self) -> list[str | None]:
        return json.loads(self._read(*self.head["names"]))

    def matrix(self) -> WaveletMatrix:
        at, plane = HEAD + 4 * self.docs, -(-self.n // 8)
        entries = -(-plane // (STEP // 8)) + 1
        data = self._read(at, self.bits * (plane + 4 * entries))
        planes = [np.frombuffer(data, np.uint8, plane, i * plane) for i in range(self.bits)]
        counts = [np.frombuffer(data, "<u4", entries, self.bits * plane + i * 4 * entries) for i in range(self.bits)]
        return WaveletMatrix(self.n, planes, counts, self.head["zeros"])


_LATIN = re.compile(r"[\x00-\u024f]*")
_KNOWN = 600_000  # units and words that a worker remembers, some 200 bytes each
_LONG = 64  # letters of the longest that it remembers
_TOGETHER = 4 << 20  # bytes of texts cut at a time
_JOINED = 20_000  # letters in one call of the library's model


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies show each byte: itself if visible, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_SHOWN = _byte_letters()
_LETTERS = dict(enumerate(_SHOWN))
_BYTES = {c: b for b, c in enumerate(_SHOWN)}


def _words_of_latin() -> re.Pattern:
    """How byte-level tokenizers of this kind cut a text into words, for characters below U+0250.

    Contractions, then letters, digits or other signs, each with a space before it, then white space, of
    which the last character is left to the word that follows.
    """
    def kind(test):
        return "".join(re.escape(chr(c)) for c in range(0x250) if test(unicodedata.category(chr(c))[0], chr(c)))

    letter, digit, space = kind(lambda k, c: k == "L"), kind(lambda k, c: k == "N"), kind(lambda k, c: c.isspace() and not "\x1c" <= c <= "\x1f")
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


_WORDS = _words_of_latin()


# Kinds of bytes: a text is cut only where bytes alone tell what their characters are.
_SPACE, _BREAK, _SIGN, _ALNUM, _MARKED, _UNSURE = range(6)


def _kinds_of_bytes() -> np.ndarray:
    """Space, other white space, signs, letters or digits, first bytes of U+00C0 to U+024F, all others."""
    kinds = np.full(256, _UNSURE, np.uint8)
    kinds[:128] = [_ALNUM if chr(b).isalnum() else _SIGN for b in range(128)]
    kinds[9:14], kinds[32], kinds[0xC3:0xCA] = _BREAK, _SPACE, _MARKED
    return kinds


_KINDS = _kinds_of_bytes()


def units_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Parts of texts that a byte-level tokenizer of this kind encodes by themselves; the number of parts of each text.

    A part starts only where one of the tokenizer's words does: at a space before what is no white space, at white space
    after what is none, after a single white space other than the space, and at a sign after a letter or digit.  The last
    character of longer white space depends on what follows, so nothing else is cut there.
    """
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    low, high = edges[0], edges[-1]
    if low == high:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    kind = _KINDS[np.frombuffer(texts.buffers()[2], np.uint8, high - low, low)]
    edges = edges - low
    ink = (kind > _BREAK) & (kind < _UNSURE)
    plain = ink & (kind < _MARKED)
    start = np.zeros(len(kind), bool)
    start[:-1] = (kind[:-1] == _SPACE) & ink[1:]
    start[edges[1:-1][edges[1:-1] > 0] - 1] = False  # what follows the last character stands in another text
    start[1:] |= plain[:-1] & (kind[1:] <= _BREAK)
    start[1:] |= (kind[:-1] == _ALNUM) & (kind[1:] == _SIGN)
    start[2:] |= plain[:-2] & (kind[1:-1] == _BREAK) & ink[2:]
    start[edges[:-1][edges[:-1] < len(kind)]] = True
    places = np.flatnonzero(start)
    offsets = np.append(places + low, high).astype(np.int32)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), texts.buffers()[2]), np.diff(np.searchsorted(places, edges))


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian numbers; every id comes from the tokenizers library.

    A byte-level tokenizer encodes each word of a text by itself, so texts are cut into units of few words, each
    different unit of a few texts is looked up once, and units and words are encoded once while they are
    remembered.  New words go to the library's model many at a time, with a byte between them that no merge of
    the vocabulary holds.  Units with characters beyond Latin are cut into words by the library; texts that hold
    an added token's string, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        before = spec.get("pre_tokenizer") or {}
        letters = set().union(*(t for t in spec["model"].get("vocab", {}) if len(t) > 1)) if spec["model"].get("type") == "BPE" else set()
        # bytes that UTF-8 never has; one that is a token by itself and in no other
        free = [_SHOWN[b] for b in range(0xF5, 0x100) if _SHOWN[b] not in letters and self.tokenizer.token_to_id(_SHOWN[b]) is not None]
        self.by_word = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and bool(letters and free)
            and not before.get("add_prefix_space") and not spec.get("normalizer")
            and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        )
        self.between = free[0] if free else ""
        most = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end)
        self.bits, self.kind = most.bit_length(), np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}  # ids of units and words

    def _learn(self, new: list[str], shown: list[str]) -> None:
        """Encode words, given also in the library's byte letters."""
        stop, code = self.tokenizer.token_to_id(self.between), "H" if self.kind.itemsize == 2 else "I"
        at = 0
        while at < len(new):
            last, n = at, 0
            while last < len(new) and n < _JOINED:
                n += len(shown[last])
                last += 1
            ids = array(code, [t.id for t in self.tokenizer.model.tokenize(self.between.join(shown[at:last]))])
            ids.append(stop)
            start = 0
            for w in new[at:last]:
                cut = ids.index(stop, start)
                self.words[w] = ids[start:cut].tobytes()
                start = cut + 1
            at = last

    def _cut(self, unit: str) -> list[str]:
        if _LATIN.fullmatch(unit):
            return _WORDS.findall(unit)
        shown = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]
        return [bytes(map(_BYTES.__getitem__, w)).decode("utf-8") for w in shown]

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of different units."""
        if len(self.words) > _KNOWN:
            # frequent ones come early and stay
            self.words = dict(islice(self.words.items(), _KNOWN // 2))
        words = self.words
        found = list(map(words.get, units))
        unknown = [i for i, x in enumerate(found) if x is None]
        cut = [self._cut(units[i]) for i in unknown]
        new = list({w: None for c in cut for w in c if w not in words})
        self._learn(new, [w.encode().decode("latin-1").translate(_LETTERS) for w in new])
        for i, c in zip(unknown, cut):
            found[i] = words[units[i]] = b"".join(map(words.__getitem__, c))
        for u in chain((units[i] for i in unknown), new):
            if len(u) > _LONG:
                words.pop(u, None)
        return found

    def _encode_units(self, texts: pa.StringArray) -> list[np.ndarray]:
        units, n_units = units_of(texts)
        coded = units.dictionary_encode()
        found = pa.array(self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, 4 * found.offset) // self.kind.itemsize
        edges = ends[np.concatenate(([0], np.cumsum(n_units)))].tolist()
        ids = np.frombuffer(found.buffers()[2] or b"", self.kind, edges[-1])
        return [ids[a:z] for a, z in zip(edges, edges[1:])]

    def encode(self, texts: pa.StringArray | list[str]) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.StringArray) else pa.array(texts, pa.string())
        whole = np.full(len(texts), not self.by_word)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        out: list = []
        if whole.any():
            kept = [t if w else None for t, w in zip(texts.to_pylist(), whole)]
            texts = pc.if_else(pa.array(whole), "", texts)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // _TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:]):
            out += self._encode_units(texts.slice(low, high - low))
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.tokenizer.encode(kept[i], add_special_tokens=False).ids, self.kind)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = END, shard_ids: int = 4 << 20) -> DataFrame:
    """Encode and write ``docs`` in ascending order; returns ``path, part, number, n_docs, n_ids`` (written).

    Ranges of doc_id are partitions; a partition writes shards of about ``shard_ids`` ids one after the other.
    """
    by_bytes(docs.sparkSession)

    def run(batches):
        encoder = _encoder(tokenizer, end)
        tail = np.array([end], encoder.kind)
        part, made, held, names, n = TaskContext.get().partitionId(), [], [], [], 0

        def close():
            nonlocal held, names, n
            path = f"{folder}/part-{part:05d}-{len(made):04d}.wvm"
            lengths = np.array([len(x) for x in held], np.int64)
            with replaced_file(path) as out:
                out.write(pack(WaveletMatrix.build(np.concatenate(held), encoder.bits), lengths, names))
            made.append((path, part, len(made), len(held), n))
            held, names, n = [], [], 0

        for b in batches:
            texts = pc.fill_null(b.column("text").cast(pa.string()), "")
            for name, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts)):
                names.append(name)
                held.append(np.concatenate((ids, tail)))
                n += len(held[-1])
                if n >= shard_ids:
                    close()
        if held:
            close()
        columns = list(zip(*made)) if made else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ["path", "part", "number", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    named = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return materialize(named.mapInArrow(run, "path string, part int, number int, n_docs long, n_ids long"), "shards")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``path, doc_id, at, n_tokens, ids_crc32`` of every document, in the order of a shard, from the files alone."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                store, where = file_system(path)
                with store.open_input_file(where) as f:
                    shard = ShardFile(f)
                    ids, lengths, names = shard.matrix().ids(), shard.lengths(), shard.names()
                edges = np.concatenate(([0], np.cumsum(lengths)))
                for a in range(0, len(lengths), 512):
                    z = min(len(lengths), a + 512)
                    part = [ids[edges[i] : edges[i + 1]].astype("<u4") for i in range(a, z)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * (z - a)), pa.array(names[a:z], pa.string()), pa.array(edges[a:z]),
                            pa.array(lengths[a:z]), pa.array([zlib.crc32(x.tobytes()) for x in part], pa.int64()),
                        ],
                        ["path", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, "path string, doc_id string, at long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end: int = END, **options) -> DataFrame:
    """Write ``docs`` as wavelet files and read them back: ``doc_id, path, start, n_tokens, ids_crc32``.

    The files hold doc_id as text, beside the lengths; ``start`` counts the ids of all documents before.
    """
    spark = docs.sparkSession
    manifest = write_shards(docs, scratch_path(spark, "wavelet"), tokenizer, end, **options)
    # one row per file: partitions are few and in order
    parts = running_offsets(manifest.groupBy(F.lit(0).alias("k"), "part").agg(F.sum("n_ids").alias("n")), ["k"], "part", "n", "before")
    inside = running_offsets(manifest.select("part", "number", "path", "n_ids"), ["part"], "number", "n_ids", "within")
    starts = inside.join(parts.select("part", "before"), "part").select("path", (F.col("before") + F.col("within")).alias("base"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        read_shards(manifest)
        .join(starts, "path", "left")  # a left join builds on the files' side only
        .select(
            F.col("doc_id").cast(kind).alias("doc_id"), "path", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
        )
    )
