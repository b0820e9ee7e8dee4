"""Collocations, fill-in-the-middle and the n-gram join against brute force, on null, empty, repeated, long and tied rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from ticketloom.llm import collocations, fill_middle, ngram_join
from ticketloom.llm.common import table
from ticketloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- collocations ----------------------------------------------------------------------------


def brute_collocations(rows, least, longest, top, covered):
    out, by = [], collections.defaultdict(list)
    for t, lang in rows:
        by[lang or "und"].append(lowered(t))
    for lang, texts in by.items():
        f = collections.Counter()
        for t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rest = []
        for p, a in found.items():
            longer = (q for q, c in found.items() if len(q) > len(p) and 100 * c >= covered * a)
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rest)[:top])]
    return sorted(out)


def phrase_rows():
    r, words = random.Random(2), ["Aa", "b", "é", "日", "q-r", "ÿ", "the", "\x1c", "x", "y1"]
    rows = [(None, None), ("", "en"), (" .,! ", "en"), ("lone", "fr")]
    for _ in range(200):
        some = [r.choice(words[: r.randint(2, 10)]) for _ in range(r.randint(1, 40))]
        ends = [" ", "  ", "\t", " ", " ", " ", ". ", "\n", "\r", ";"]
        rows.append(("".join(w + r.choice(ends) for w in some), r.choice(["en", "en", "de", None, "und"])))
    return rows + rows[10:20] + [("x y1 the " * 30_000, "fr")]


@pytest.mark.parametrize("least,longest,top,covered,states", [(5, 5, 2000, 100, 1_000_000), (3, 5, 20, 60, 7), (4, 3, 50, 100, 3)])
def test_collocations(spark, least, longest, top, covered, states):
    """Small ``states`` give several tries a language; a small ``top`` cuts among ties."""
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "clash", "dot") for r in rows], "text string, lang string, words string, `a.b` string")
    found = collocations.collocations(df, least, longest, top, covered, states)
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, least, longest, top, covered)


def test_no_collocations(spark):
    df = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df).count() == 0


def test_scores_beyond_64_bits():
    """Counts that corpora of 10^13 words have; the same expression as in the query."""
    a, n, left, right = 10**11, 10**13, 3 * 10**11, 7 * 10**11
    assert 1000 * a * n > 1 << 64
    from pyspark.sql import SparkSession

    row = SparkSession.active().sql(
        f"select cast(cast({a} as decimal(18,0)) * cast(1000 as decimal(4,0)) as decimal(20,0)) * cast({n} as decimal(18,0)) x"
    ).selectExpr(f"x div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0))) s")
    assert row.first().s == 1000 * a * n // (left * right)


@pytest.mark.parametrize("depth,words,phrases", [(1, 50, 30), (2, 40, 300), (4, 8, 500), (3, 300, 3000)])
def test_double_array(depth, words, phrases):
    r = np.random.default_rng(depth)
    names = np.unique(r.integers(-(2**62), 2**62, words))
    rows = np.unique(names[r.integers(0, len(names), (phrases, depth))], axis=0)
    trie = collocations.Trie.build(rows, r.permutation(len(rows)).astype(np.int64))
    numbers = {tuple(p): int(trie.value[_walk(trie, p)]) for p in rows.tolist()}
    assert sorted(numbers.values()) == list(range(len(rows)))
    text = names[r.integers(0, len(names), 3000)]
    text[::17] = 0
    into = np.full(3000, -1)
    trie.match(text, into)
    assert into.tolist() == [numbers.get(tuple(text[i : i + depth].tolist()), -1) for i in range(3000)]


def _walk(trie, phrase):
    s = 0
    for w in phrase:
        t = trie.base[s] + np.searchsorted(trie.alphabet, w)
        assert trie.check[t] == s
        s = t
    return s


# ---- fill-in-the-middle ----------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text, unit="word", seed=42):
    text = text or ""
    units = TOKEN.findall(text) if unit == "word" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    x, y = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), out, text)


def middle_rows():
    r = random.Random(1)
    rows = [(None, None), (1, ""), (2, " \n"), (3, "a <P> b"), (4, "x"), (None, "é y"), (4, "x"), (5, "日本😀 é\t" * 90_000)]
    return rows + [(i, "".join(r.choice("ab é日😀 \t\n\x0b\x1c<P>S") for _ in range(r.randint(1, 60)))) for i in range(6, 300)]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle(spark, monkeypatch, unit):
    rows = middle_rows()
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, `h.1` string, n int")
    made = fill_middle.restored(fill_middle.fill_in_middle(df, unit))
    got = sorted((tuple(r) for r in made.collect()), key=str)
    assert got == sorted((brute_middle(*r, unit) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(df, "line")


def test_exceptions_turn_bytes_into_characters_and_back(monkeypatch):
    """Blocks smaller than the texts."""
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    for _, t in middle_rows():
        t = (t or "")[:200]
        data = np.frombuffer(t.encode(), np.uint8)
        index, words = fill_middle.Exceptions(data), fill_middle.Words(data)
        cuts = [len(t[:i].encode()) for i in range(len(t) + 1)]
        assert index.n_chars == len(t) and len(index.bytes) == sum(ord(c) > 127 for c in t)
        assert [index.to_bytes(i) for i in range(len(cuts))] == cuts
        assert [index.to_chars(b) for b in cuts] == list(range(len(cuts)))
        units = TOKEN.findall(t)
        assert words.n == len(units)
        assert [words.end(i) for i in range(words.n + 1)] == [len("".join(units[:i]).encode()) for i in range(words.n + 1)]


# ---- n-gram join -----------------------------------------------------------------------------


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else [])


def brute_components(rows, size, share):
    sets, parent = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
            parent[top(j)] = top(i)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[top(i)].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in groups.items()}
    return sorted(((d, len(s), least[top(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies():
    """Groups of near copies, a shared passage, a chain of texts near the threshold, and rows without words."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["É", "ab", "AB"]

    def prose(n):
        return [r.choice(words) for _ in range(n)]

    rows = [(None, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c"), (None, "x y z t"), (None, "x y z t")]
    passage = prose(30)
    for base in range(40):
        own = prose(r.choice([3, 4, 5, 8, 20, 60, 150, 400])) + (passage if base % 5 == 0 else [])
        for _ in range(r.choice([1, 1, 2, 5, 20])):
            x = list(own)
            for _ in range(r.randint(0, max(1, len(x) // 25))):
                i = r.randrange(len(x))
                x[i : i + r.randint(0, 1)] = prose(r.randint(0, 1)) if len(x) > 1 else x
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(x)))
    chain = prose(200)
    for _ in range(30):
        chain = list(chain)
        at = r.randrange(190)
        chain[at : at + 4] = prose(4)
        rows.append((len(rows), " ".join(chain)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,share,tile", [(4, 85, 5), (3, 60, 2048)])
def test_ngram_components(spark, monkeypatch, size, share, tile):
    """A tile of five sets makes blocks; a low share makes trees that fail and are looked at again."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_copies()
    df = spark.createDataFrame([(*r, "c", "z") for r in rows], "doc_id long, text string, `a.b` string, cid string")
    found = ngram_join.ngram_components(df, size, share)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == brute_components(rows, size, share)


def test_ngram_join_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngram_join.ngram_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.ngram_components(df, 4, 100)


def test_bands_and_bitmaps_never_exclude_a_link():
    r = np.random.default_rng(1)
    edges = ngram_join.bands(85)
    for n in range(1, 3000):
        m = np.arange(n, n * 100 // 85 + 1)
        assert (np.searchsorted(edges, m, side="right") - np.searchsorted(edges, n, side="right") <= 1).all()
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) < 0.9], r.integers(0, 2**63, r.integers(0, 60)).astype(np.uint64))))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        x, y = ngram_join._folded([ngram_join.bitmap(a, 512), ngram_join.bitmap(b, 128)], 16)
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= len(a) + len(b) - 2 * both
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert ngram_join._allowed(len(a), len(b), differ, 85)


def test_long_texts_are_split_into_words_as_whole_ones(monkeypatch):
    text = (" Ab c\td\x0b" * 500 + "e" * 300 + " f").encode()
    whole = ngram_join.Shingler().set(text)
    monkeypatch.setattr(ngram_join, "PIECE", 50)
    assert np.array_equal(ngram_join.Shingler().set(text), whole)


def test_queries_return_a_row_for_each_document(spark):
    n = table(spark, DATA, "documents").count()
    made = QUERIES["op12_fill_in_middle"](spark, DATA)
    texts = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in table(spark, DATA, "documents").collect()}
    assert {r.doc_id: r.restored_sha256 for r in made.collect()} == texts
    assert QUERIES["op13_ngram_components"](spark, DATA).count() == n
