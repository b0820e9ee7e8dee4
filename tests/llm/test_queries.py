"""Nearest neighbours, WARC packages and the pipeline; queries against brute force on the smallest tables."""

import base64
import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ticketloom.llm import decontaminate, neighbours, simhash, warc
from ticketloom.llm.common import table

DATA = "/root/testdata/sf0.001"


def exact(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        others = ids != ids[i]
        order = np.lexsort((ids[others], -s[others]))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[others][order], s[others][order])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_supplied_vectors(spark):
    v = table(spark, DATA, "embeddings")
    got = found(neighbours.nearest(v, "vec_id", "embedding", 20, 20))
    want = exact([(r.vec_id, r.embedding) for r in v.collect()], 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        scores = dict(exact([(r.vec_id, r.embedding) for r in v.collect()], 20, 10_000)[q]) if q == 0 else {}
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        assert all(scores[a] == pytest.approx(s, abs=1e-12) for a, s in rows if scores)


def test_neighbours_with_norms_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * rng.uniform(0.2, 5)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1060)]  # copies: more than a result holds
    good = list(rows)
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (2060, [float("inf")] + [0.0] * 5)]
    rows += [(None, [1.0] * 6), (2080, [1.0, 2.0]), (2100, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, v array<float>, e string")
    got, want = found(neighbours.nearest(df, "id", "v", 20, 20)), exact(good, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q in want:
        if want[q][19][1] > want[q][0][1] - 1e-9:  # only copies of one vector: ties go to smaller ids
            assert [a for a, _ in got[q]] == [a for a, _ in want[q]]
    assert neighbours.nearest(df.limit(0), "id", "v", 20).count() == 0
    few = found(neighbours.nearest(spark.createDataFrame(rows[:3], "id long, v array<float>"), "id", "v", 20))
    assert [a for a, _ in few[0]] == [a for a, _ in exact(rows[:3], 20, 20)[0]]


def test_recall_of_clustered_vectors_holds_in_every_tenth_of_the_queries(spark):
    """Tight clusters and isolated vectors: buckets fitted to the former don't find the neighbours of the latter."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 32))
    x = np.vstack([centres[rng.integers(0, 60, 2400)] + 0.05 * rng.standard_normal((2400, 32)), rng.standard_normal((150, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(rng.permutation(len(x)), x)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 10, 20))
    want = exact(rows, 10, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.sort([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    assert min(t.mean() for t in np.array_split(recall, 10)) >= 0.9


def test_small_tables_are_met_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a) for a in rng.standard_normal(8)]) for i in range(0, 300, 20)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 20, 20))
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in exact(rows, 20, 20).items()}


def test_split_buckets_lose_nothing(spark, monkeypatch):
    v = table(spark, DATA, "embeddings")
    whole = found(neighbours.nearest(v, "vec_id", "embedding", 20, 20))
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 5)
    assert found(neighbours.nearest(v, "vec_id", "embedding", 20, 20)) == whole


PAGES = [
    (3, "http://a/ü\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (5, "http://b", ""),
    (None, "http://c", "<p>é</p>"), (7, "http://d", "x" * 200_000), (1, None, "<p>é</p>"), (9, "u", "lone"), (None, "n", "none"),
]


def test_warc_packages(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha1 string")
    manifest = warc.write_packages(pages, f"file://{tmp_path}/w", package_bytes=400)
    rows = warc.read_packages(manifest).collect()
    first = {}
    for p, _, h in sorted(PAGES, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(h or "", p)
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = first[h or ""] != p
        want.append((p, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all("\r" not in r.url and "\n" not in r.url for r in rows)
    # a standard reader sees the same archive
    path = manifest.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert gzip.decompress(z.read(warc.ARCHIVE)).startswith(b"WARC/1.1\r\n")
    assert warc.archive_pages(pages.limit(0)).count() == 0
    large = warc.archive_pages(pages, min_bytes=5).filter("payload_bytes = 0").collect()
    assert {r.record_type for r in large} == {"response"}


def test_zip64_directories_are_read():
    """A package whose central directory states all places and sizes in ZIP64 fields."""
    data, name = b"payload", warc.ARCHIVE.encode()
    local = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1, len(name), 20)
    local += name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack(
        "<4s6H3I5H2I", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1
    ) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 4) + b"note"
    file = io.BytesIO(local + central + end64 + locator + end)
    members = warc.directory(file, len(file.getvalue()))
    at, n = warc.stored_range(file, members, warc.ARCHIVE)
    assert file.getvalue()[at : at + n] == data
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no zip at all"), 13)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, "x" * 99)
    with pytest.raises(ValueError):
        warc.stored_range(packed, warc.directory(packed, len(packed.getvalue())), warc.ARCHIVE)


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {n for n in range(1, 14)} == {int(q[2:].split("_")[0]) for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names


def test_pipeline(spark):
    """Every stage against what it should keep of the one before, by brute force."""
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, docs, DATA)
    assert known.columns == columns
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in known.collect()} == letters
    one = stages["SimHash near-dedup"](spark, known, DATA)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(known).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values()))
    clean = stages["benchmark decontamination"](spark, one, DATA)
    report = decontaminate.Decontamination(one, table(spark, DATA, "benchmark")).report()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in report.filter("not contaminated").collect())
    mixed = corpus_pipeline.materialize(stages["mixing sources"](spark, clean, DATA), "mixed")
    assert mixed.columns == columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    total = sum(len(r.text.split()) for r in clean.collect())
    assert abs(sum(words.values()) - total) < 0.05 * total
    tokens = stages["token output"](spark, mixed, DATA)
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(r.doc_id for r in mixed.collect())
    assert corpus_pipeline.run(spark, DATA).count() == tokens.count()
