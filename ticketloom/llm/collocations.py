"""Phrase collocations, mined level by level with double-array tries.

Texts are cut into pieces and words; words are counted first.  Then a frequent word becomes its 64-bit hash, other
words and piece borders a zero, and these codes are written.  (Two words of one language with one hash
would be an error, and it is checked.)

A candidate of k words is Apriori-safe: its first and its last k - 1 words are frequent.  The frequent phrases
of k - 1 words of each language lie in double-array tries.  In every task numpy advances
the states of all text positions at once, level by level; positions that reach an accepting state hold a
frequent phrase, and a candidate is a pair of accepting states at neighbouring positions.  Pairs are counted with
``bincount`` over their compact numbers, and Spark sums the shards.  So candidates that no text holds are never
built: pairs of frequent words alone would be hundreds of millions.

Tries hold at most ``STATES`` phrases; where a language has more, it gets several, split by first word,
and tasks hold one at a time.  They are built in tasks and read from the shared folder.

Pieces end at ``[.,;:!?]`` and 0x0A-0x0D, words are runs of characters other than space and tab, A-Z are
lower-cased.  Null text is empty, null language is ``und`` (and one with rows that say ``und``).  Repeated rows count again.  An
empty table gives no rows.  Columns other than text and lang are not looked at, whatever their names.
"""

from __future__ import annotations

import io
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.llm.common import by_bytes, file_system, materialize, replaced_file, scratch_path, texts_of

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000
COVERED = 100  # percent of a phrase's occurrences that a longer one must have to replace it
STATES = 1_000_000
HELD = 1 << 21  # words, pairs or phrases that a task holds before it hands on their counts
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_SPREAD = 64


class _Hashes(dict):
    """Hashes of words, each computed once while it is remembered."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        h = self[word] = h if h not in (0, 1) else 2  # 0 and 1 stand for no word
        return h


def _cut(text: bytes) -> list[bytes]:
    """Words of a text, a newline between pieces and empty strings in between."""
    return text.lower().translate(_PIECES).replace(b"\n", b" \n ").split(b" ")


def _rows(docs: DataFrame) -> DataFrame:
    by_bytes(docs.sparkSession)
    return docs.select(
        F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """``lang, code, word, a``: every word with its hash and its count."""

    def counted(seen):
        for lang, words in seen.items():
            for border in (b"", b"\n"):
                words.pop(border, None)
            items = list(words.items())
            for at in range(0, len(items), 50_000):
                word, n = zip(*items[at : at + 50_000])
                hashes = _Hashes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([hashes[w] for w in word], pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64())],
                    ["lang", "code", "word", "n"],
                )

    def run(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(texts_of(b.column("text")), b.column("lang").to_pylist()):
                seen.setdefault(lang, Counter()).update(_cut(text))
                if sum(map(len, seen.values())) > HELD // 8:
                    yield from counted(seen)
                    seen = {}
        yield from counted(seen)

    words = _rows(docs).mapInArrow(run, "lang string, code long, word binary, n long")
    found = words.groupBy("lang", "code").agg(F.sum("n").alias("a"), F.min("word").alias("word"), F.max("word").alias("other"))
    found = materialize(found, "words")
    if found.filter("word != other").limit(1).count():
        raise ValueError("two words have one hash")
    return found.drop("other")


def encoded(docs: DataFrame, files: dict[str, list[str]]) -> DataFrame:
    """``lang, codes``: texts as the hashes of their frequent words, with one zero for all that lies between two of them.

    A text without two frequent words in a row has no row.
    """

    def run(batches):
        hashes, held, loaded = _Hashes({b"\n": 0, b"": 1}), [], _Loaded()

        def listed():
            edges = np.cumsum([0, *[len(c) for _, c in held]], dtype=np.int32)
            lists = pa.ListArray.from_arrays(edges, np.concatenate([c for _, c in held]))
            out = pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in held], pa.string()), lists], ["lang", "codes"])
            held.clear()
            return out

        for b in batches:
            size = 0
            for text, lang in zip(texts_of(b.column("text")), b.column("lang").to_pylist()):
                words = _cut(text)
                codes = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
                codes = codes[codes != 1]
                numbers = np.full(len(codes), -1, np.int64)
                for path in files.get(lang, ()):
                    loaded(path).match(codes, numbers)
                codes[numbers < 0] = 0
                # words between two zeros stand alone, of zeros in a row one is enough
                zero = np.concatenate(([True], codes == 0, [True]))
                codes = codes[~((zero[:-2] & zero[2:]) | (zero[1:-1] & zero[:-2]))]
                if len(codes):
                    held.append((lang, np.append(codes, 0)))
                    size += len(codes)
                if len(hashes) > HELD // 8:
                    hashes = _Hashes({b"\n": 0, b"": 1})
                if size > HELD // 8:
                    yield listed()
                    size = 0
            if held:
                yield listed()

    return _rows(docs).mapInArrow(run, "lang string, codes array<long>")


# ---- double-array tries ----------------------------------------------------------------------


class Trie:
    """Phrases of one length.  State t is reached from s by symbol c if base[s] + c = t and check[t] = s.

    ``value`` of a state at full depth is the phrase's number.  Symbols are ranks in ``alphabet``.
    """

    def __init__(self, alphabet, base, check, value, depth):
        self.alphabet, self.base, self.check, self.value, self.depth = alphabet, base, check, value, depth

    @classmethod
    def build(cls, phrases: np.ndarray, numbers: np.ndarray) -> "Trie":
        """From distinct phrases (rows of word hashes)."""
        alphabet, symbols = np.unique(phrases, return_inverse=True)
        symbols = symbols.reshape(phrases.shape)
        order = np.lexsort(symbols.T[::-1])
        symbols, numbers = symbols[order], numbers[order]
        n, depth = symbols.shape
        size = 2 * len(alphabet) + 4 * n + 1024
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value, used = np.full(size, -1, np.int64), np.zeros(size, bool)
        used[0] = True  # the root
        state = np.zeros(n, np.int32)  # of the prefix of each phrase
        new = np.zeros(n, bool)
        new[0] = True
        for d in range(depth):
            group = np.flatnonzero(new)  # prefixes of d words, each a node with children
            new = new.copy()
            new[1:] |= symbols[1:, d] != symbols[:-1, d]
            child = np.flatnonzero(new)
            owner = np.searchsorted(group, child, side="right") - 1
            kids, edges = symbols[child, d], np.searchsorted(owner, np.arange(len(group) + 1))
            placed, low = np.empty(len(child), np.int32), 1
            for k in np.argsort(edges[:-1] - edges[1:], kind="stable"):  # nodes with most children first
                own = kids[edges[k] : edges[k + 1]]
                while True:
                    # free places for the first child that leave room for all
                    free = np.flatnonzero(~used[max(low, own[0]) : max(low, own[0]) + 4096]) + max(low, own[0])
                    tried, fits = 0, np.empty(0, int)
                    while tried < len(free) and not len(fits):
                        some = free[tried : tried + 64] - own[0]
                        reach = some[-1] + own[-1] + 1
                        if reach > len(used):
                            grow = max(reach, 2 * len(used)) - len(used)
                            base, check = np.pad(base, (0, grow)), np.pad(check, (0, grow), constant_values=-1)
                            value, used = np.pad(value, (0, grow), constant_values=-1), np.pad(used, (0, grow))
                        fits = some[~used[some[:, None] + own].any(axis=1)]
                        tried += 64
                    if len(fits):
                        break
                    low = max(low, own[0]) + 4096
                    if low + 4096 > len(used):
                        grow = len(used)
                        base, check = np.pad(base, (0, grow)), np.pad(check, (0, grow), constant_values=-1)
                        value, used = np.pad(value, (0, grow), constant_values=-1), np.pad(used, (0, grow))
                at = fits[0] + own
                used[at] = True
                parent = state[group[k]]
                base[parent], check[at] = fits[0], parent
                placed[edges[k] : edges[k + 1]] = at
            state = placed[np.searchsorted(child, np.arange(n), side="right") - 1]
        value[state] = numbers
        last = int(np.flatnonzero(used)[-1]) + 1
        return cls(alphabet, base[:last], check[:last], value[:last], depth)

    def save(self, out) -> None:
        data = io.BytesIO()
        np.savez(data, alphabet=self.alphabet, base=self.base, check=self.check, value=self.value, depth=self.depth)
        out.write(data.getvalue())

    @classmethod
    def load(cls, path: str) -> "Trie":
        fs, at = file_system(path)
        with fs.open_input_stream(at) as f, np.load(io.BytesIO(f.read())) as z:
            return cls(z["alphabet"], z["base"], z["check"], z["value"], int(z["depth"]))

    def match(self, codes: np.ndarray, into: np.ndarray) -> None:
        """Write the numbers of the phrases that start at each position into ``into``."""
        symbol = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[symbol] == codes, symbol, -1).astype(np.int32)
        alive = np.flatnonzero(symbol[: len(codes) - self.depth + 1] >= 0)
        state = np.zeros(len(alive), np.int32)
        for d in range(self.depth):
            s = symbol[alive + d]
            to = self.base[state] + s
            ok = (s >= 0) & (to < len(self.check))
            ok[ok] = self.check[to[ok]] == state[ok]
            alive, state = alive[ok], to[ok]
        into[alive] = self.value[state]


class _Loaded:
    """Tries that a task has read, as many as four full ones take."""

    def __init__(self):
        self.tries: dict[str, Trie] = {}

    def __call__(self, path: str) -> Trie:
        if path not in self.tries:
            if sum(len(t.base) for t in self.tries.values()) > 4 * STATES:
                self.tries.clear()
            self.tries[path] = Trie.load(path)
        return self.tries[path]


def tries(phrases: DataFrame, states: int) -> dict[str, list[str]]:
    """Files of the tries of each language: ``phrases`` has ``lang, pid, words``."""
    folder = scratch_path(phrases.sparkSession, "tries")
    sizes = phrases.groupBy("lang").agg(F.ceil(F.count("*") / states).cast("int").alias("shards"))
    dealt = phrases.join(F.broadcast(sizes), "lang").withColumn(
        "shard", F.pmod(F.xxhash64(F.col("words")[0]), F.col("shards")).cast("int")
    )

    def run(batches):
        held = []

        def built(rows):
            lang, shard = rows.column("lang")[0].as_py(), rows.column("shard")[0].as_py()
            words = rows.column("words").combine_chunks()
            trie = Trie.build(words.flatten().to_numpy().reshape(len(words), -1), rows.column("pid").to_numpy())
            path = f"{folder}/{xxhash.xxh3_64_hexdigest(lang.encode())}-{shard}.npz"
            with replaced_file(path) as out:
                trie.save(out)
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([path])], ["lang", "path"])

        for b in batches:
            if not b.num_rows:
                continue
            key = pc.binary_join_element_wise(b.column("lang"), b.column("shard").cast(pa.string()), "\n").to_pylist()
            at = 0
            for i in range(1, len(key) + 1):
                if i == len(key) or key[i] != key[at]:
                    if held and held[0][0] != key[at]:
                        yield built(pa.Table.from_batches([x for _, x in held]))
                        held = []
                    held.append((key[at], b.slice(at, i - at)))
                    at = i
        if held:
            yield built(pa.Table.from_batches([x for _, x in held]))

    rows = dealt.select("lang", "shard", "pid", "words").repartition("lang", "shard").sortWithinPartitions("lang", "shard")
    files: dict[str, list[str]] = {}
    for r in rows.mapInArrow(run, "lang string, path string").collect():  # one row for each STATES phrases
        files.setdefault(r.lang, []).append(r.path)
    return files


def neighbours(texts: DataFrame, files: dict[str, list[str]]) -> DataFrame:
    """``p, q, n``: how often phrase q starts one word after phrase p."""

    def run(batches):
        trie = _Loaded()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed():
            p, q, n = (np.concatenate(x) for x in zip(*held))
            pair = np.lexsort((q, p))
            p, q, n = p[pair], q[pair], n[pair]
            first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
            held[:] = [(p[first], q[first], np.add.reduceat(n, first))]

        def rows():
            summed()
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["p", "q", "n"])
            held.clear()
            return out

        for b in batches:
            langs = b.column("lang").to_numpy(zero_copy_only=False)
            lists = b.column("codes")
            flat = lists.flatten().to_numpy()
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for lang in dict.fromkeys(langs):
                codes = np.concatenate([flat[edges[i] : edges[i + 1]] for i in np.flatnonzero(langs == lang)])
                numbers = np.full(len(codes) + 1, -1, np.int64)
                for path in files.get(lang, ()):
                    trie(path).match(codes, numbers)
                at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
                if not len(at):
                    continue
                known, compact = np.unique(np.concatenate((numbers[at], numbers[at + 1])), return_inverse=True)
                pair, accepted = np.unique(compact[: len(at)] * np.int64(len(known)) + compact[len(at) :], return_inverse=True)
                held.append((known[pair // len(known)], known[pair % len(known)], np.bincount(accepted)))
            if sum(len(x[0]) for x in held) > HELD:
                summed()
                if len(held[0][0]) > HELD // 2:
                    yield rows()
        if held:
            yield rows()

    found = texts.mapInArrow(run, "p long, q long, n long")
    return found.groupBy("p", "q").agg(F.sum("n").alias("a"))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, states: int = STATES
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    spark = docs.sparkSession
    words = vocabulary(docs)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    word = F.col("word").cast("string")
    number = F.monotonically_increasing_id().alias("pid")
    level = materialize(
        words.filter(F.col("a") >= least).select(
            "lang", number, F.array("code").alias("words"), word.alias("phrase"), word.alias("last"), "a",
            F.array("a").alias("firsts"), F.array("a").alias("lasts"),
        ),
        "phrases",
    )
    scored, kept, texts = [], [], None
    for k in range(2, longest + 1):
        if not (files := tries(level, states)):
            break
        if texts is None:
            texts = materialize(encoded(docs, files), "encoded")
        pairs = neighbours(texts, files).filter(F.col("a") >= least)
        p, q = (level.select(*[F.col(c).alias(f"{s}_{c}") for c in level.columns]) for s in "pq")
        longer = pairs.join(p, F.col("p") == F.col("p_pid")).join(q, F.col("q") == F.col("q_pid"))
        grown = materialize(
            longer.select(
                F.col("p_lang").alias("lang"), number, F.concat("p_words", F.slice("q_words", -1, 1)).alias("words"),
                F.concat_ws(" ", "p_phrase", "q_last").alias("phrase"), F.col("q_last").alias("last"), "a",
                # occurrences of the first and of the last 1 .. k words
                F.concat("p_firsts", F.array("a")).alias("firsts"), F.concat("q_lasts", F.array("a")).alias("lasts"),
                "p", "q",
            ),
            "phrases",
        )
        if k > 2:
            kept.append((level, grown))
        level = grown.drop("p", "q")
        scored.append(level)
    if not scored:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    out = None
    for i, phrases in enumerate(scored):
        if i < len(kept):
            # a longer candidate that holds the phrase leads through one with a word more that has as many occurrences
            more = kept[i][1]
            best = more.select(F.col("p").alias("pid"), F.col("a").alias("more")).union(more.select("q", "a"))
            best = best.groupBy("pid").agg(F.max("more").alias("more"))
            phrases = phrases.join(best, "pid", "left").filter(
                F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * covered)
            ).drop("more")
        out = phrases if out is None else out.unionByName(phrases)
    exact = "decimal(18,0)"
    out = out.join(F.broadcast(totals), "lang")
    above = (F.col("a").cast(exact) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * F.col("n").cast(exact)
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.struct(F.col("firsts")[k - 1].alias("l"), F.col("lasts")[F.size("words") - k - 1].alias("r"), k.alias("k")),
    )
    # a product of two counts below 10^18 has at most 36 digits, and the three have 38 up to 10^17 words
    rows = out.withColumn("cut", F.explode(cuts)).select("lang", "phrase", "pid", "a", "n", "cut.*", above.alias("above"))
    rows = rows.withColumn("score", F.expr(f"above div (cast(l as {exact}) * cast(r as {exact}))"))
    low = rows.groupBy("lang", "phrase", "pid", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = (F.desc("score"), F.desc("a"), F.col("phrase"))
    found = low.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(_SPREAD)).alias("salt"))
    few = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
