"""Toxicity by a learned lexicon in a trie, met by Levenshtein automata.

Learning: of at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled rows (drawn by a hash
of the id) all beginnings of words are counted by document.  A beginning that stands in toxic documents
far more often than chance allows, and almost never in clean ones, may be a term; places in quotation
don't count in either, some wrong labels are allowed for, and terms are
counted by the words around them, so that copies of a toxic text make no terms.  A term is a stem if words go on from it, a whole word if it ends there.

Matching: terms lie in a trie; a word is run through it with a Levenshtein automaton (one row
of edit distances for each node), so misspelled terms are met as well: one edit from five letters, two from
eight.  Distances that meet clean documents in the sample are switched off for that term.
A context window around a hit tells quotation (quote marks around it, or a word of speech
before it) from abuse; quoted hits weigh less.

A logistic model over the sum of hits, fitted on the same sample, gives the score.
Null and empty texts have no hits and get the score of such texts.  Without labels of both
kinds the lexicon is empty and the score is the prior.  Repeated rows score alike.
An empty table gives no rows; columns other than doc_id and text, and doc_id and toxic of the labels, are not looked at.
"""

from __future__ import annotations

import re
from math import exp, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ticketloom.llm.common import by_bytes, crc_fold, low_hash, materialize

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
SHORTEST, LONGEST = 4, 16
TERMS = 20_000  # significant beginnings among which terms are chosen
IMPURE = 0.005  # share of clean documents that a term may have of its share of toxic ones
WRONG = 0.02  # share of a term's documents that may be labelled clean by mistake
DEVIATIONS = 3.0  # by which clean documents must exceed what is allowed, as chance varies them
SURELY = 0.7  # share of toxic places that a term with more than IMPURE clean ones must have beyond chance
END = "$"
QUOTED, MISSPELLED = 0.4, 0.8  # what such a hit weighs
CONTEXT = 48  # characters on each side of a hit
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")
# Words of speech that introduce a quotation.
_SPEECH = re.compile(
    r"\b(said|says|wrote|quote[ds]?|called|sagte|schrieb|zitat|dit|écrit|cité|dijo|escribió|cita)\b[^.!?]*$", re.I
)
_ANY_SPEECH = re.compile(_SPEECH.pattern.removesuffix("[^.!?]*$"), re.I)
_OPEN, _CLOSE = "\"'“„«‘", "\"'”“»’"


def beginnings(text: str) -> dict[str, int]:
    """All beginnings of the text's words, ends marked, each with a hash of the words around its first place out of quotation."""
    out: dict[str, int] = {}
    lowered = text.lower()
    shown = text if len(lowered) == len(text) else lowered
    speaks = any(q in text for q in _OPEN) or _ANY_SPEECH.search(text)
    places = list(_WORD.finditer(lowered))
    words = [m.group() for m in places]
    seen = set()
    for before, w, after, m in zip(["", *words], words, [*words[1:], ""], places):
        if w in seen or speaks and quoted(shown, *m.span()):
            continue
        seen.add(w)
        around = crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))
        w += END
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            out.setdefault(w[:n], around)
    return out


def choose_terms(toxic: dict[str, int]) -> list[str]:
    """Terms out of significant beginnings: the shortest ones, each drawn out as long as that loses no document."""
    terms, longer = [], {}
    for b in sorted(toxic):
        longer.setdefault(b[:-1], []).append(b)
    for b in sorted(toxic, key=lambda x: (len(x), x)):
        if any(b[:n] in toxic for n in range(SHORTEST, len(b))):
            continue
        while next_ := [x for x in longer.get(b, ()) if toxic[x] >= 0.95 * toxic[b]]:
            b = next_[0]
        terms.append(b)
    return terms


def surprise(p: int, n: int, share: float) -> float:
    """Chernoff's bound, as a negative logarithm, of the chance that p of p + n places are toxic if a ``share`` of all is."""
    if not p or p / (p + n) <= share:
        return 0.0
    return p * log(p / (p + n) / share) + (n * log(n / (p + n) / (1 - share)) if n else 0.0)


def pure(p: int, n: int, n1: int, n0: int, tests: int) -> bool:
    """Whether n clean documents beside p toxic places are few, or wrong labels and chance explain them."""
    if n * n1 <= IMPURE * p * n0:
        return True
    expected = p * (IMPURE * n0 / n1 + WRONG)
    return n <= expected + DEVIATIONS * expected**0.5 and surprise(p, n, SURELY) >= log(20 * tests)


def edits(term: str) -> int:
    n = len(term.rstrip(END))
    return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """Terms in a trie, intersected with the Levenshtein automata of all of them at once.

    A state is a set of (trie node, edits so far); a letter of the word moves it along an equal
    edge, over any edge or past a letter at the cost of an edit, and edges may be skipped at that cost.
    States are made deterministic as words need them, so that a word costs one lookup a letter, up to the first
    letter after which no term is in reach.
    """

    def __init__(self, terms: list[str], allowed: dict[str, int] | None = None):
        self.allowed = {t: edits(t) if allowed is None else allowed.get(t, 0) for t in terms}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.most = [-1]  # the edits that any term at or below a node allows
        for t in terms:
            node = 0
            self.most[0] = max(self.most[0], self.allowed[t])
            for ch in t.rstrip(END):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(-1)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], self.allowed[t])
            self.ends[node].append(t)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple[int, str] | None] = []
        self.wholes: list[tuple[int, str] | None] = []
        self.first = self._state([(0, 0)])

    def _state(self, pairs) -> int:
        """Number of a state, or -1 if nothing is in reach."""
        best: dict[int, int] = {}
        open_ = list(pairs)
        while open_:
            node, e = open_.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            open_ += [(child, e + 1) for child in self.children[node].values()]
        if not best:
            return -1
        state = frozenset(best.items())
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            met = [(e, t) for node, e in state for t in self.ends[node] if e <= self.allowed[t]]
            self.stems.append(min((x for x in met if not x[1].endswith(END)), default=None))
            self.wholes.append(min((x for x in met if x[1].endswith(END)), default=None))
        return self.numbers[state]

    def _move(self, state: int, ch: str) -> int:
        pairs = []
        for node, e in self.sets[state]:
            pairs.append((node, e + 1))
            for edge, child in self.children[node].items():
                pairs.append((child, e + (edge != ch)))
        new = self.moves[state][ch] = self._state(pairs)
        return new

    def match(self, word: str) -> tuple[int, str] | None:
        """The nearest term (edit distance, term) that a lower-cased word matches."""
        if len(self.sets) > 100_000:
            self._reset()
        state, best, moves, stems = self.first, None, self.moves, self.stems
        for ch in word:
            if state < 0:
                return best
            if stems[state] and (best is None or stems[state] < best):
                best = stems[state]
            new = moves[state].get(ch)
            state = self._move(state, ch) if new is None else new
        for found in (stems[state], self.wholes[state]) if state >= 0 else ():
            if found and (best is None or found < best):
                best = found
        return best


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit speaks of quotation."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    opened = max((before.rfind(q) for q in _OPEN), default=-1)
    if opened >= 0 and any(q in after for q in _CLOSE) and not re.search(r"[.!?]\s", before[opened:]):
        mark = before[opened]
        if mark not in "'’" or opened == 0 or not before[opened - 1].isalnum():
            return True
    return bool(_SPEECH.search(before))


def hits(text: str, lexicon: Lexicon) -> list[tuple[int, int, int, str, bool]]:
    """``(start, end, distance, term, quoted)`` of each word that matches."""
    out = []
    lowered = text.lower()
    met = {w: found for w in set(_WORD.findall(lowered)) if (found := lexicon.match(w))}
    if not met:
        return out
    same = len(lowered) == len(text)
    for m in _WORD.finditer(lowered):
        if found := met.get(m.group()):
            out.append((*m.span(), *found, quoted(text if same else lowered, *m.span())))
    return out


def evidence(found: list[tuple[int, int, int, str, bool]]) -> float:
    """Weighted hits up to one whole one: terms are chosen to be toxic by themselves, so one plain hit is enough."""
    return min(1.0, sum((QUOTED if q else 1.0) * (MISSPELLED if d else 1.0) for *_, d, _, q in found))


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = self.weights @ np.array([1.0, evidence(hits(text, self.lexicon)) if text else 0.0])
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method for a logistic model of weighted rows, drawn to ``prior`` weights (the bias is free)."""
    w = prior.copy()
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n * (p - y)) + pull * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """``text, toxic`` of the labelled rows that are learned from, at most so many of each kind."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("toxic") == 1, toxic_rows).otherwise(clean_rows)
    known = known.filter(F.col("doc_id").isNotNull() & (crc_fold() != 1))
    rows = known.groupBy("toxic").agg(F.count("*").alias("n"))  # two rows
    near = F.when(F.col("toxic") == 1, low_hash(F.col("n"), toxic_rows)).otherwise(low_hash(F.col("n"), clean_rows))
    drawn = (
        known.join(F.broadcast(rows), "toxic")
        .filter(near)
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= most)
        .select("doc_id", "toxic")
    )
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learn lexicon and weights from the labelled rows of folds other than 1."""
    by_bytes(docs.sparkSession)
    rows = materialize(sample(docs, labels, toxic_rows, clean_rows), "toxic-sample")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    empty = Lexicon([])
    if not n1 or not n0:
        return Model(empty, np.array([log((n1 + 0.5) / (n0 + 0.5 + 9 * (n1 + n0 == 0))), 4.0]))

    def count(batches):
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                some = beginnings(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64()), pa.array([int(toxic)] * len(some), pa.int64())],
                    ["b", "around", "toxic"],
                )

    # copies of a toxic text repeat all its words; a term is one that stands among different words
    places = rows.mapInArrow(count, "b string, around long, toxic long").groupBy("b", F.when(F.col("toxic") == 1, F.col("around")).alias("around"))
    counted = places.agg(F.count("*").alias("c")).groupBy("b").agg(
        F.count("around").alias("p"), F.coalesce(F.sum(F.when(F.col("around").isNull(), F.col("c"))), F.lit(0)).alias("n")
    )
    counted = materialize(counted.filter("p >= 3"), "beginnings")
    # a beginning at p toxic places and no other stands there only by chance with probability share^p
    tests, share = max(counted.count(), 1), n1 / (n1 + n0)
    least = max(3, int(np.ceil(log(20 * tests) / -log(share))))
    judged = F.udf(lambda p, n: surprise(p, n, share) >= log(20 * tests) and pure(p, n, n1, n0, tests), "boolean")
    apart = counted.filter(F.col("p") >= least).filter(judged("p", "n"))
    significant = {r.b: r.p for r in apart.orderBy(F.desc("p"), "b").limit(TERMS).collect()}
    terms = choose_terms(significant)
    open_ = Lexicon(terms)

    def nearest(batches):
        for b in batches:
            out = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found = hits(text, open_)
                exact = any(not d for *_, d, _, _ in found)
                # a misspelling is judged in documents that have no exact hit, where it isn't quoted
                out += {(t, d, int(toxic)) for *_, d, t, q in found if d and not q and not exact}
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                ["term", "d", "toxic"],
            )

    met = rows.mapInArrow(nearest, "term string, d long, toxic long").groupBy("term", "d").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")
    )
    allowed = {t: edits(t) for t in terms}
    for r in met.collect():  # terms x distances
        if not pure(r.p, r.n, n1, n0, 2 * len(terms)):
            allowed[r.term] = min(allowed[r.term], r.d - 1)
    lexicon = Lexicon(terms, allowed)

    def measure(batches):
        for b in batches:
            x = [evidence(hits(t, lexicon)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic").cast(pa.int64())], ["x", "y"])

    # as many rows as there are sums of hits
    table = rows.mapInArrow(measure, "x double, y long").groupBy("x", "y").agg(F.count("*").alias("n")).collect()
    x = np.array([(1.0, r.x) for r in table])
    y, n = np.array([r.y for r in table], float), np.array([r.n for r in table], float)
    return Model(lexicon, logistic(x, y, n, np.array([log((n1 + 0.5) / (n0 + 0.5)), 4.0])))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``; only the text reaches the model."""
    by_bytes(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = [model.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", (crc_fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
