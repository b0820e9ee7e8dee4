"""Fill-in-the-middle rearrangement over a sparse index of multibyte characters.

A text is cut twice, and its parts come as prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each
behind its sentinel.  Cuts are drawn from the sha256 of seed and doc_id, so reruns agree.

Texts stay UTF-8 bytes.  Most characters are one byte, so only the exceptions are
indexed: the byte position of every multibyte character and the excess bytes up to it.  One
binary search there turns a byte cut into code points or back; between exceptions it is arithmetic.
Words are counted block by block and only the two blocks that hold a cut are looked at again.

A word is a run of other characters with the white space (0x09-0x0D, 0x20) before it; white space at the end is one
more.  A null text is empty.  An empty text, and one that contains a sentinel, stays
plain, so every output can be taken apart again.  A null doc_id draws as an empty one.  Repeated rows give repeated
results, an empty table none; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import by_bytes, texts_of

SEED = 42
RATE = 50  # of 100 texts that are rearranged
SPM = 80  # of 100 rearranged texts that come as suffix, prefix, middle
SENTINELS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 20


class Exceptions:
    """Multibyte characters of a UTF-8 text."""

    def __init__(self, data: np.ndarray):
        at, more = [np.empty(0, np.uint32)], [np.empty(0, np.uint8)]
        for k in range(0, len(data), BLOCK):
            own = data[k : k + BLOCK]
            lead = np.flatnonzero(own >= 0xC0)
            at.append((lead + k).astype(np.uint32))
            more.append(1 + (own[lead] >= 0xE0).astype(np.uint8) + (own[lead] >= 0xF0))
        self.bytes = np.concatenate(at)
        excess = np.cumsum(np.concatenate(more), dtype=np.uint32)
        self.excess = np.concatenate((np.zeros(1, np.uint32), excess))  # before the i-th exception
        self.chars = self.bytes - self.excess[:-1]
        self.n_chars = len(data) - int(self.excess[-1])

    def to_chars(self, at: int) -> int:
        return at - int(self.excess[np.searchsorted(self.bytes, np.uint32(at))])

    def to_bytes(self, at: int) -> int:
        return at + int(self.excess[np.searchsorted(self.chars, np.uint32(at))])


class Words:
    """Ends of the words of a text, found again in their block."""

    def __init__(self, data: np.ndarray):
        self.data = data
        counts = [len(self._ends(k)) for k in range(0, len(data), BLOCK)]
        self.upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.n = int(self.upto[-1]) + (len(data) > 0)

    def _ends(self, k: int) -> np.ndarray:
        own = self.data[k : k + BLOCK + 1]
        space = (own == 32) | ((own >= 9) & (own <= 13))
        return np.flatnonzero(~space[:-1] & space[1:]) + k + 1

    def end(self, i: int) -> int:
        """The byte after the first i words."""
        if i == 0 or i == self.n:
            return len(self.data) if i else 0
        block = int(np.searchsorted(self.upto, i)) - 1
        return int(self._ends(block * BLOCK)[i - 1 - self.upto[block]])


def cut(data: bytes, one: int, two: int, unit: str) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """``n``, the two byte cuts, and the code points of prefix and middle, for two draws over n units."""
    a = np.frombuffer(data, np.uint8)
    index = Exceptions(a)
    if unit == "char":
        n = index.n_chars
        x, y = sorted((one % (n + 1), two % (n + 1)))
        return n, (index.to_bytes(x), index.to_bytes(y)), (x, y - x)
    words = Words(a)
    x, y = (words.end(i) for i in sorted((one % (words.n + 1), two % (words.n + 1))))
    first = index.to_chars(x)
    return words.n, (x, y), (first, index.to_chars(y) - first)


def fill_in_middle(
    docs: DataFrame, unit: str = "word", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, one row per row of ``docs``.

    unit: "word" or "char", what n counts and cuts fall between.
    """
    if unit not in ("word", "char"):
        raise ValueError(unit)
    by_bytes(docs.sparkSession)
    p, s, m = marks = [t.encode() for t in sentinels]

    def run(batches):
        for b in batches:
            draws = [b.column(f"h{i}").to_pylist() for i in range(1, 5)]
            out = []
            for data, one, two, three, four in zip(texts_of(b.column("text")), *draws):
                n, (x, y), chars = cut(data, one, two, unit)
                if not data or three % 100 >= rate or any(t in data for t in marks):
                    out.append((n, "plain", None, None, data))
                elif four % 100 < spm:
                    out.append((n, "spm", *chars, b"".join((s, data[y:], p, data[:x], m, data[x:y]))))
                else:
                    out.append((n, "psm", *chars, b"".join((p, data[:x], s, data[y:], m, data[x:y]))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), *draws)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add ``restored``: the text, rebuilt from ``output`` and ``form`` alone; each sentinel is in a rearranged output once."""
    p, s, m = sentinels

    def before(c, mark):
        return F.substring_index(c, mark, 1)

    def behind(c, mark):
        return F.substring_index(c, mark, -1)

    out = F.col("output")
    middle = behind(out, m)
    psm = F.concat(before(behind(out, p), s), middle, before(behind(out, s), m))
    spm = F.concat(before(behind(out, p), m), middle, before(behind(out, s), p))
    return rows.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))
