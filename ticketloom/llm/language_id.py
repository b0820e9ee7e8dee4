"""Language identification in two steps: the family, then the language within it.

Features are square roots of the counts of hashed letter pairs and triples of the whole
lower-cased text, of length one.  One linear machine per family tells it from
the other families; within a family one machine for each pair of its languages
votes.  Machines are fitted on at most ``PER_LANGUAGE`` labelled rows of each language,
drawn by a hash of the id; every row is predicted from its text alone.

Text that is null or has no letter is ``und`` with score 0.  With no labelled
rows all text is ``und``; with one language that one is the answer.  Languages outside the
table of families are families of their own.  Repeated rows are predicted alike.
An empty table gives no rows; other columns are kept by ``known_language``, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ticketloom.llm.common import by_bytes, crc_fold, low_hash, whole_row
from ticketloom.llm.svm import linear_svm

PER_LANGUAGE = 300
FEATURES = 1 << 13
UNKNOWN = "und"
# Families of closely related languages by code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa"),
    "sinitic": ("yue", "zh"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_BLOCK = 1 << 19  # code points at a time


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 17)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all but letters as 0."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = c < (1 << 17)
    letter = np.where(known, _letters()[np.where(known, c, 0)], False)
    if not known.all():
        letter[~known] = [chr(x).isalpha() for x in c[~known].tolist()]
    return np.where(letter, c, 0)


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed pairs and triples; None if no letter stands in the text."""
    c = np.concatenate((np.zeros(1, np.uint32), _codes(text), np.zeros(1, np.uint32))).astype(np.uint64)
    if not c.any():
        return None
    out = np.zeros(FEATURES, np.int64)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    for at in range(0, len(c) - 1, _BLOCK):
        a = c[at : at + _BLOCK + 2]
        pair = a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        own = slice(0, _BLOCK)
        keep = ((a[:-1] | a[1:]) != 0)[own]
        out += np.bincount(((pair * np.uint64(0xD6E8FEB86659FD93)) >> shift)[own][keep].astype(np.int64), minlength=FEATURES)
        triple = pair[:-1] + a[2:] * np.uint64(0x165667B19E3779F9)
        keep = (a[1:-1] != 0)[own]
        out += np.bincount(((triple * np.uint64(0xA0761D6478BD642F)) >> shift)[own][keep].astype(np.int64), minlength=FEATURES)
    return out


def features(text: str) -> np.ndarray | None:
    n = counts(text)
    return None if n is None else np.sqrt(n / n.sum()).astype(np.float32)


class Model:
    """Machines of the families, and of the pairs of languages in each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array(langs)
        family = np.array([_FAMILY.get(v, v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: sorted(set(y[family == f])) for f in self.families}
        self.columns, weights = {}, []

        def fit(name, rows, positive):
            self.columns[name] = len(weights)
            weights.append(linear_svm(x[rows], np.where(positive[rows], 1.0, -1.0)))

        for f in self.families if len(self.families) > 1 else ():
            fit(("family", f), np.ones(len(y), bool), family == f)
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                fit((a, b), (y == a) | (y == b), y == a)
        w = np.array(weights, np.float32).reshape(-1, x.shape[1] + 1)
        self.w, self.bias = w[:, :-1].T.copy(), w[:, -1]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        m = x @ self.w + self.bias
        sure = 1 / (1 + np.exp(-4 * m))
        score = np.ones(len(x))
        if len(self.families) > 1:
            at = [self.columns["family", f] for f in self.families]
            family = m[:, at].argmax(axis=1)
            score = sure[:, at][np.arange(len(x)), family]
        else:
            family = np.zeros(len(x), int)
        out = np.empty(len(x), object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            langs = self.members[f]
            votes = np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                p = sure[rows, self.columns[langs[a], langs[b]]]
                votes[:, a] += p
                votes[:, b] += 1 - p
            best = votes.argmax(axis=1)
            out[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[rows] *= votes[np.arange(len(rows)), best] / (len(langs) - 1)
        return out.tolist(), score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows of folds other than 1 with a language; at most ``per_language`` rows of each."""
    by_bytes(docs.sparkSession)
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "th")
    known = docs.select("doc_id", "lang", F.xxhash64("text").alias("th"), F.lower(F.col("text")).rlike(r"\p{L}").alias("letters")).filter(
        F.col("lang").isNotNull() & F.col("letters") & (crc_fold() != 1)
    )
    rows = known.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    keys = (
        known.join(F.broadcast(rows), "lang")
        .filter(low_hash(F.col("n"), per_language))
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= per_language)
        .select(F.struct("doc_id", "th", "lang").alias("k"))
        .distinct()
    )
    sample = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th"), "lang").alias("k"), "text").join(F.broadcast(keys), "k", "left_semi")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            ok = [i for i, v in enumerate(x) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").take(pa.array(ok, pa.int64())), pa.array([x[i].astype(np.float16).tobytes() for i in ok], pa.binary())],
                ["lang", "x"],
            )

    rows = sample.select(F.col("k.lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = sorted(map(tuple, rows.mapInArrow(run, "lang string, x binary").collect()))
    if not rows:
        return None
    return Model(np.array([np.frombuffer(x, np.float16) for _, x in rows]).astype(np.float32), [lang for lang, _ in rows])


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_row`` (its columns), ``lang_pred`` and ``score``; only the text reaches the model."""
    by_bytes(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts) if model else 0, 256):
                x = [(i, v) for i in range(at, min(at + 256, len(texts))) if texts[i] and (v := features(texts[i])) is not None]
                if x:
                    found, score = model.predict(np.array([v for _, v in x]))
                    for (i, _), lang, s in zip(x, found, score):
                        langs[i], scores[i] = lang, s
            rest = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    kept = ["_row"]
    rows = docs.select(whole_row(docs).alias("_row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``."""
    model = fit(docs.select("doc_id", "text", "lang"), per_language)
    found = predictions(docs.select("doc_id", "text"), model)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", crc_fold() == 1).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def known_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows whose text has a language, with all their columns; ``und`` goes."""
    model = fit(docs.select("doc_id", "text", "lang"), per_language)
    return predictions(docs, model).filter(F.col("lang_pred") != UNKNOWN).select("_row.*")
