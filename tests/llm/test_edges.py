"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator on documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from ticketloom.llm import decontaminate, language_id, mixing, secret_scan, simhash, suffix_dedup, toxicity, wavelet
from ticketloom.llm.queries import TOKENIZER

RNG = random.Random(5)
VOCABULARY = ["the", "of", "é", "naïve", "Zoo", "x1", "river", "stone", "walks", "under", "ÿ", "日本", "cloud", "seven"]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 99)
ROWS = [
    (1, prose(80, 1), "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "fr", "b"),
    (5, prose(20, 2) + " " + PASSAGE + " " + prose(30, 3), "en", "b"),
    (6, PASSAGE + "!", "de", "a"),
    (7, prose(9000, 4), "en", "c"),
    (1, prose(80, 1), "en", "a"),  # a repeated row
    (1, prose(50, 8), "en", "b"),  # another text under its id
    (None, prose(40, 6), "en", "c"),
    (None, None, None, None),
    (8, "12345 !!! 678", "en", "a"),
    (9, "日本 日本 日本", "en", "a"),
]


def texts(rows=ROWS):
    return [(r[0], r[1] or "") for r in rows]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_secret_scan(documents):
    key = "password: 'Abc123xyz'"
    rows = [*ROWS, (20, "ééé " + key + " AKIA" + "Q7" * 10 + " " + "ab12" * 8, "en", "a")]
    found = secret_scan.spans_digest(secret_scan.find_secrets(documents(rows)))
    by = {r.doc_id: r for r in found.collect() if r.doc_id == 20}
    assert (by[20].n_assign, by[20].n_access, by[20].n_hex) == (1, 1, 1)
    assert by[20].spans.startswith(f"assign:4:{4 + len(key) - 1},access:")
    assert found.count() == len(rows)
    assert {r.base_sha256 for r in found.filter("doc_id in (2, 3)").collect()} == {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("window", [3, 20])
def test_entropy_by_counts_equals_entropy_by_windows(window):
    def entropy(s):
        p = np.array([s.count(c) for c in set(s)]) / len(s)
        return -(p * np.log2(p)).sum()

    for _ in range(50):
        s = "".join(RNG.choice("abcdEF01") for _ in range(RNG.randint(1, 60)))
        w = min(window, len(s))
        assert secret_scan.highest_entropy(s, window) == pytest.approx(max(entropy(s[i : i + w]) for i in range(len(s) - w + 1)), abs=1e-9)


def test_allowed_strings_are_no_secrets():
    scan = lambda t: secret_scan.scan(t, re.compile("|".join(f"(?:{a})" for a in secret_scan.ALLOWED).replace("(?i)", ""), re.I), secret_scan.THRESHOLDS, 20)
    assert [x[0] for x in scan("key Zx81kPq0VtR7mLw3YbN5 end")] == ["entropy_base64"]
    assert scan("id 3f2b8c1e-9d4a-4e6f-8a7b-0c1d2e3f4a5b end") == []
    assert scan("Zx81kPq0VtR7mLwEXAMPLE3YbN5") == []
    assert scan("a_failing=token=abc token=token:secretvalue") == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_contamination(rows, items):
    windows, lengths = {}, set()
    for i, t in items:
        w = WORD.findall(lowered(t or ""))
        n = min(10, len(w))
        lengths.add(n)
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for n in lengths - {0}:
            for a in range(len(w) - n + 1):
                if x := windows.get(tuple(w[a : a + n])):
                    found |= x
                    hit |= set(range(a, a + n))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "items",
    [
        [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (10, "River STONE walks"), (11, "日本"), (None, prose(12, 1)), (4, None), (5, " ,. ")],
        [(1, prose(9, 4)), (2, prose(5, 4)), (3, prose(6, 1))],
        [],
    ],
)
def test_decontamination(spark, documents, items):
    bench = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, words string")
    found = decontaminate.Decontamination(documents(ROWS), bench)
    assert got(found.report(), "doc_id", "n_words", "n_hit", "items") == brute_contamination(texts(), items)
    clean = [r[0] for r, b in zip(sorted(ROWS, key=str), sorted(ROWS, key=str)) if not brute_contamination([(r[0], r[1] or "")], items)[0][2]]
    kept = found.clean()
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == documents([]).columns


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(documents):
    found = simhash.fingerprints(documents(ROWS))
    assert got(found, "doc_id", "fp") == sorted(((d, int(np.uint64(brute_fingerprint(t)).astype(np.int64))) for d, t in texts()), key=str)


def test_lists_of_the_index_count_the_shared_bytes(spark):
    """Meeting in 1, 7 or 28 lists is the tally of 6, 7 or 8 shared bytes; with fewer there is no list, and no link."""
    r = random.Random(8)
    pairs = []
    for distance in range(5):
        for _ in range(60):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), distance):
                b ^= 1 << bit
            pairs.append((a, b, distance))
    signed = [(i, int(np.uint64(x).astype(np.int64)), int(np.uint64(y).astype(np.int64))) for i, (x, y, _) in enumerate(pairs)]
    df = spark.createDataFrame(signed, "i long, x long, y long")
    lists = [df.select("i", simhash._postings(c).alias("p")).select("i", "p.*") for c in "xy"]
    met = {r.i: r["count"] for r in lists[0].join(lists[1], ["i", "place", "rest"]).groupBy("i").count().collect()}
    for i, (a, b, distance) in enumerate(pairs):
        shared = sum((a >> 8 * k) & 255 == (b >> 8 * k) & 255 for k in range(8))
        assert met.get(i, 0) == {6: 1, 7: 7, 8: 28}.get(shared, 0)
        assert distance > simhash.BITS or shared >= simhash.KEPT


def test_links_equal_brute_force(spark):
    """Chains, a cluster that fills one list, and random fingerprints."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    for seed in list(fps)[:20]:
        x = seed
        for _ in range(r.randint(1, 12)):
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(x)
    hub = r.getrandbits(64)
    fps |= {hub ^ v for v in range(700)} | {0, 3}
    f = sorted(fps)
    a = np.array(f, np.uint64)
    root = list(range(len(f)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            x, y = top(i), top(int(j))
            root[max(x, y)] = min(x, y)
    want = {}
    for i in range(len(f)):
        want.setdefault(top(i), set()).add(int(a[i].astype(np.int64)))
    rows = spark.createDataFrame([(int(x.astype(np.int64)),) for x in a], "fp long")
    found = {}
    for n in simhash.components(simhash.links(rows)).collect():
        found.setdefault(n.root, set()).add(n.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_near_duplicates_and_their_representatives(documents):
    found = simhash.near_duplicates(documents(ROWS))
    assert found.count() == len(ROWS)
    zero = {r.component_id for r in found.filter("fp = 0").collect()}
    assert zero == {2}
    kept = simhash.one_of_each(documents(ROWS))
    assert kept.columns == documents([]).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(2) == 1 and 3 not in ids and ids.count(1) == 2 and ids.count(None) == 1


def test_suffix_dedup(documents):
    rows = [*ROWS, (30, "ab" * 400, "x", "a"), (31, "z" + "ab" * 90, "x", "a"), (32, prose(300, 4)[17:], "x", "a")]
    want = []
    seen = {}
    for _, t in texts(rows):
        b = t.encode()
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for d, t in texts(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    for group in (5_000, 3):  # the second deals every larger anchor over several groups
        original = suffix_dedup.removed.__defaults__
        suffix_dedup.removed.__defaults__ = (200, group)
        try:
            found = suffix_dedup.digest(suffix_dedup.deduplicated(documents(rows)))
            assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
        finally:
            suffix_dedup.removed.__defaults__ = original


def test_suffix_sort_is_lexicographic():
    data = np.frombuffer(bytes(RNG.choice(b"ab") for _ in range(600)) + b"\0" * 40, np.uint8)
    group = np.array([RNG.randrange(5) for _ in range(560)])
    order = suffix_dedup.Suffixes(data, 40).sort(group, np.arange(560))
    raw = data.tobytes()
    assert [(group[i], raw[i : i + 40]) for i in order] == sorted((group[i], raw[i : i + 40]) for i in range(560))


def test_mixing(documents):
    rows = [(i, prose(100 + i % 7, i), "en", s) for i, s in enumerate(["a"] * 60 + ["b"] * 20 + [None] * 10 + ["c"] * 3)] + ROWS
    mix = mixing.Mix(documents(rows), block_words=8)
    out = mix.taken().collect()
    assert sorted((r.doc_id, r["size"]) for r in out if r.doc_id is not None) == sorted(
        (d, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t in texts(rows) if d is not None
    )
    assert len(out) == len(rows) and all(r.taken <= 3 * r["size"] for r in out)
    again = mixing.Mix(documents(rows[::-1]), block_words=8).taken()
    assert got(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in out), key=str)
    by = {}
    for r in out:
        x = by.setdefault((r.source_size, r.target), [0])
        x[0] += r.taken
    for (_, target), (taken,) in by.items():
        assert abs(taken - target) <= 3 * 8 + 0.02 * target
    assert mixing.Mix(documents([])).taken().count() == 0


def test_small_and_null_sources_meet_their_targets(documents):
    small = {"tiny": 10, "s20": 20, "s50": 50, None: 70, "s200": 200}
    rows = [(i, prose(500, i), "en", "big") for i in range(40)]
    for s, n in small.items():
        rows += [(len(rows), prose(n - n // 2, n), "en", s), (len(rows) + 1, prose(n // 2, n + 1), "en", s)]
    names = {i: s for i, _, _, s in rows}
    by = {}
    for r in mixing.Mix(documents(rows)).taken().collect():
        x = by.setdefault(names[r.doc_id], [0, r.target])
        x[0] += r.taken
    assert {s: x[0] for s, x in by.items() if s != "big"} == {s: 3 * n for s, n in small.items()}
    assert abs(by["big"][0] - by["big"][1]) <= 32
    words = {}
    for r in mixing.mixed_documents(documents(rows)).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert words == {s: x[0] for s, x in by.items()}
    # none of them stops at the limit: targets between and below whole blocks
    rows = [(i, prose(10 + 25 * (i % 4), i), "en", f"s{i:02}") for i in range(24)]
    for r in mixing.Mix(documents(rows)).taken().collect():
        assert abs(r.taken - r.target) <= max(1.0, r.target / 10)


def test_targets_stop_at_the_limit_and_share_the_rest():
    assert mixing.targets([100, 10, 10], [5, 2, 1]) == pytest.approx([75, 30, 15])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5])


def test_permutation_and_shard_counts():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 77)) == list(range(n))
    counts = np.array([5000, 3, 0, 997])
    parts = [mixing.shard_counts(i, 12, counts, 500, 1) for i in range(12)]
    assert (sum(c for c, _ in parts) == counts).all()
    assert all(c.sum() == 500 for c, _ in parts)
    assert (parts[5][1] == sum(c for c, _ in parts[:5])).all()


def test_mixed_documents_hold_whole_texts_or_taken_words(documents):
    rows = [(i, prose(150, i), "en", "ab"[i % 2]) for i in range(40)]
    out = mixing.mixed_documents(documents(rows), block_words=16)
    assert out.columns == documents([]).columns
    whole = dict((i, t) for i, t, *_ in rows)
    for r in out.collect():
        words = iter(whole[r.doc_id].split())
        assert r.text == whole[r.doc_id] or all(w in words for w in r.text.split())
        assert r.n_chars == len(r.text)
    assert mixing.mixed_documents(documents([])).count() == 0


def test_token_output(documents):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [*ROWS, (40, "x <|endoftext|> y", "en", "a"), (41, "a b  c \n\n d", "en", "a")]
    out = wavelet.token_output(documents(rows), TOKENIZER, shard_ids=500).collect()
    assert len(out) == len(rows)
    by = {}
    for d, t in texts(rows):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        by.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        by[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(by.values())
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order)
    assert wavelet.token_output(documents([]), TOKENIZER).count() == 0


def test_units_of_texts_are_encoded_like_whole_texts():
    """The table holds every kind of white space, contractions, signs and characters beyond Latin, in any order."""
    r = random.Random(3)
    parts = [
        *" \n\t\r\x0b\x0c\x1c\x85\xa0\u3000'',!-aBst1é×¿²中😀", " ", "'re", "'ll", "the", " the", "<|endoftext|>", "\x00", "x" * 70,
    ]
    table = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    encoder = wavelet.Encoder(TOKENIZER)
    for text, ids in zip(table, encoder.encode(table)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_remembers_short_words_only():
    """Words of 20,000 letters would fill a worker: what it remembers has a bound in bytes, not in words alone."""
    r = random.Random(4)
    table = [" ".join("".join(r.choices("abcd", k=20_000)) for _ in range(5)) + " river" for _ in range(4)]
    encoder = wavelet.Encoder(TOKENIZER)
    for text, ids in zip(table, encoder.encode(table)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert " river" in encoder.words and sum(map(len, encoder.words)) < 1000


def test_wavelet_matrix():
    ids = np.array([RNG.choice([0, 1, 5, 5, 5, 900, 65_535]) for _ in range(3000)])
    w = wavelet.WaveletMatrix.build(ids, 16)
    assert (w.ids() == ids).all()
    for i in (0, 511, 512, 2999):
        assert w.access(i) == ids[i]
    for v in (0, 5, 900, 7):
        at = np.flatnonzero(ids == v)
        assert w.count(v) == len(at) and w.count(v, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
        assert [w.locate(v, k) for k in range(0, len(at), 97)] == at[::97].tolist()
    with pytest.raises(IndexError):
        w.locate(7, 0)
    assert wavelet.WaveletMatrix.build(np.empty(0, int), 16).ids().size == 0


GERMANIC, ROMANCE = {"en": "the and with this water over there", "de": "und nicht der schön über wasser auch"}, {
    "fr": "les vous être avec l'eau très où", "es": "los usted años con agua niño muy"
}


def test_language(documents):
    r = random.Random(1)
    rows = []
    for i in range(240):
        lang, line = r.choice(list({**GERMANIC, **ROMANCE}.items()))
        words = line.split()
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(8, 40))), lang, "a"))
    rows += [(900, None, "en", "a"), (901, "12 34 ...", "en", "a"), (None, "the water and the water", None, None), (902, "", "fr", "a")]
    out = language_id.identify(documents(rows)).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if (r.doc_id or 0) >= 900} == {900: "und", 901: "und", 902: "und"}
    kept = language_id.known_language(documents(rows))
    assert kept.columns == documents([]).columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in language_id.identify(documents([(1, "abc")])).collect()} == {"und"}
    assert language_id.identify(documents([])).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents([(i, "abc def", "xx", "s") for i in range(9)])).collect()} == {"xx"}


def test_toxicity(spark, documents):
    r = random.Random(2)
    words = [a + b for a in ("ra", "li", "mo", "te") for b in ("ndo", "vik", "sel", "pur", "gon")]
    rows, marks = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(["worthless", "scumbag", "vexu" + r.choice(["an", "is", "or", "el"])])
        rows.append((i, " ".join(w), "en", "a"))
        marks.append((i, 1, int(toxic)))
    rows += [(700, " ".join(words[:9]) + " worthles " + words[3]), (701, 'he said "worthless" and left'), (702, None), (None, "")]
    labels = spark.createDataFrame([*marks, (703, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {m[0]: m[2] for m in marks}
    assert np.mean([out[i].predicted == truth[i] for i in truth if out[i].held_out]) > 0.98
    assert out[700].predicted == 1 and out[702].predicted == 0 and out[None].predicted == 0
    assert out[701].score < out[next(i for i in truth if truth[i] and "worthless" in rows[i][1])].score
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(documents(ROWS), none).collect()} == {0}


def test_quoted_clean_labels_and_wrong_ones_keep_terms(spark, documents):
    r = random.Random(3)
    words = [a + b for a in ("ra", "li", "mo", "te") for b in ("ndo", "vik", "sel", "pur", "gon")]
    rows, truth, marks = [], {}, []
    for i in range(900):
        w = [r.choice(words) for _ in range(30)]
        at = r.randrange(5, 25)
        if i % 6 == 0:
            w[at] = ("trash", "worthless")[i // 6 % 2]
        elif i % 6 == 1:  # clean labelled documents that merely quote, some of them a misspelled word
            w[at] = r.choice(['"trash"', 'wrote trash', '"worthles"', '"worthless"'])
        rows.append((i, " ".join(w), "en", "a"))
        truth[i] = int(i % 6 == 0)
        marks.append((i, 1, 0 if i % 6 == 0 and i % 50 == 0 else truth[i]))  # a few toxic ones are labelled clean
    rows.append((1000, " ".join(words[:9]) + " worthles " + words[3], "en", "a"))
    model = toxicity.fit(documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert set(model.lexicon.allowed) == {"trash$", "worthless$"}
    out = {r.doc_id: r.predicted for r in toxicity.score(documents(rows), model).collect()}
    assert {i for i in truth if out[i]} == {i for i in truth if truth[i]}
    # words that are in quotation in both kinds are no terms
    said = [(i, f'{" ".join(r.choice(words) for _ in range(9))} "hello" {r.choice(words)}', "en", "a") for i in range(300)]
    model = toxicity.fit(documents(said), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int"))
    assert not model.lexicon.allowed


def test_lexicon_equals_edit_distances():
    lexicon = toxicity.Lexicon(["loser$", "disgusting$", "lowei", "scum$"])

    def row(a, b):
        r = list(range(len(b) + 1))
        for i, x in enumerate(a):
            n = [i + 1]
            for j, y in enumerate(b):
                n.append(min(r[j + 1] + 1, n[j] + 1, r[j] + (x != y)))
            r = n
        return r

    for _ in range(3000):
        w = list(RNG.choice(["loser", "disgusting", "loweian", "scum", "loose", "xlowei"]))
        for _ in range(RNG.randint(0, 3)):
            w[RNG.randrange(len(w))] = RNG.choice(["", "a", "lo", "s"])
        w = "".join(w)
        want = []
        for t, k in lexicon.allowed.items():
            d = row(t.rstrip("$"), w)
            d = d[-1] if t.endswith("$") else min(d)
            want += [(d, t)] if d <= k else []
        assert lexicon.match(w) == min(want, default=None), w


def test_secrets_of_every_character_class():
    scan = lambda t: [x[0] for x in secret_scan.scan(t, re.compile(r"(?!)"), secret_scan.THRESHOLDS, 20)]
    assert scan("key k7q9zr2m5x8wv4tb6njd1hpc3 end") == ["entropy_lower"]
    assert scan("key QwErTyUiOpAsDfGhJkLzXcVb end") == ["entropy_mixed"]
    assert scan("getElementByIdentifierName configurationbackup20 internationalisationisation") == []


@pytest.mark.parametrize("stage", ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token output"])
def test_pipeline_stages_on_edges(spark, stage, tmp_path):
    """Null, empty, repeated and very long rows, columns with dots and inner names; and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [*ROWS, (30, prose(40_000, 5), "en", "a"), (31, "lines\n\n" * 300 + "\tend", "en", "c")]
    docs = spark.createDataFrame(
        [(*r, len(r[1] or ""), "x", 1, 2) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `_row` int, size int",
    )
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, f"file://{tmp_path}").collect()
    assert run(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
    if stage == "token output":
        assert len(out) == len(rows)
        return
    assert out and set(out[0].asDict()) == set(docs.columns) and {r["a.b"] for r in out} == {"x"}
    texts_in = {r[1] for r in rows}
    if stage != "mixing sources":
        assert {r.text for r in out} <= texts_in
        return
    for r in out:  # taken words come in order, with the white space between them
        lines = [line.strip() for line in r.text.split("\n")]
        assert any(d == r.doc_id and all(line in (t or "") for line in lines) for d, t, *_ in rows) and r.n_chars == len(r.text)


def test_repeats_in_periodic_and_well_compressing_texts(documents):
    """Intervals of a periodic text are one a byte before they are merged; long texts that compress a hundred times."""
    rows = [(1, "ab" * 100_000), (2, "x" * 60_000), (3, "lone text " + prose(90, 3)), (4, ("same line of text\n" * 3000) + "end"), (5, "ab" * 99)]
    found = {r.doc_id: r for r in suffix_dedup.deduplicated(documents(rows)).collect()}
    whole = {1: 200_000, 2: 60_000, 4: 18 * 3000}
    for i, n in whole.items():
        assert [(s.start, s.end) for s in found[i].spans] == [(0, n)]
    assert not found[3].spans and not found[5].spans and bytes(found[4].kept) == b"end"
    assert bytes(found[3].kept).decode() == rows[2][1]
