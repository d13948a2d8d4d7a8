"""Hard negatives, ranked search and archives against SQL, brute force and round trips."""

import io
import itertools
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from orderlens.llm import lexical, warc, zone_negatives
from orderlens.session import scratch_path
from orderlens.verify import duckdb_con

SF = "/root/testdata/sf0.001"


def oracle(sql):
    cur = duckdb_con(SF).execute(sql)
    return [d[0] for d in cur.description], sorted(map(tuple, cur.fetchall()), key=str)


@pytest.mark.parametrize("query, sql", [(zone_negatives.op11_zone_negatives, zone_negatives.ORACLE), (lexical.op12_lexical_search, lexical.ORACLE), (warc.op13_warc, warc.ORACLE)])
def test_matches_sql(spark, query, sql):
    names, rows = oracle(sql)
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == rows and rows


# --- 11 --------------------------------------------------------------------------------


def test_hilbert_key_walks_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        path = cells[np.argsort(zone_negatives.hilbert_key(cells, bits), kind="stable")]
        assert len(np.unique(zone_negatives.hilbert_key(cells, bits))) == len(cells)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_negatives(rows, every=100):
    """rows: (uid, vec_id, label, integer vector)."""
    out = []
    for a in rows:
        if a[1] % every:
            continue
        scored = sorted(((int(a[3] @ b[3]), b[1], b[0], b[2] == a[2]) for b in rows if b[0] != a[0]), key=lambda x: (-x[0], x[1], x[2]))
        for ps, pid, _, _ in [s for s in scored if s[3]][:5]:
            window = [s for s in scored if not s[3] and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out += [(a[1], pid, k + 1, nid, ps, ns) for k, (ns, nid, _, _) in enumerate(window)]
    return sorted(out)


def test_negatives_equal_brute_force_on_clusters(spark, monkeypatch):
    """Clusters (so that blocks are left out), a vector that many rows share, repeated ids, small blocks."""
    for name, value in (("BLOCK", 8), ("GROUP", 4), ("CHUNK", 7), ("ANCHOR_STEP", 3), ("RUN_GROUPS", 2)):
        monkeypatch.setattr(zone_negatives, name, value)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 10)) * 3
    rows = [(i, int(r.integers(0, 3)), (centres[i % 12] + r.normal(size=10) * 0.2).tolist()) for i in range(0, 1600, 2)]
    rows += [(10_000 + i, i % 2, [2.0] * 10) for i in range(150)] + [(200, 1, [0.5] * 10), (200, 2, [0.25] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' AS uid", "1 AS block", "2 AS chunk", "3 AS score")
    whole = [(k, i, lab, np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(np.int64)) for k, (i, lab, x) in enumerate(rows)]
    got = sorted(tuple(x) for x in zone_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(whole) and got


def test_zone_bounds_hold_and_leave_blocks_out():
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8)) * 600
    blocks = [(centres[b] + r.normal(size=(20, 8)) * 9).astype(np.int64) for b in range(6)]
    group = zone_negatives._group([(np.arange(20), np.arange(20), np.full(20, b % 2), v) for b, v in enumerate(blocks)]).to_pylist()[0]
    zones = zone_negatives.Zones(group, 8)
    anchors = np.concatenate([v[:2] for v in blocks])
    low, high = zones.bounds(anchors)
    for b, v in enumerate(blocks):
        own = anchors @ v.T
        assert (low[:, b] <= own.min(axis=1)).all() and (high[:, b] >= own.max(axis=1)).all()
    row = {"uids": np.arange(12), "ids": np.arange(12), "labels": np.zeros(12, np.int64), "vectors": anchors, "least": (anchors * anchors).sum(axis=1) * 9 // 10}
    chunk = zone_negatives.Chunk({k: v.astype(np.int64).tobytes() for k, v in row.items()} | {"windows": None}, 8)
    assert 0 < zone_negatives.needed(zones, chunk).sum() < 12


def test_negatives_defined_cases(spark):
    schema = "vec_id long, label int, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (100, None, [1.0, 1.0]), (200, 1, None), (300, 1, [nan, 1.0]), (400, 1, [None, 1.0]), (500, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]),
            (1, 1, [1.0, 1.0]), (2, 2, [1.0]), (3, 2, [0.9, 0.9]), (4, 2, [0.9, 0.9]), (5, 2, [0.9, 0.9, 7.0]), (6, 2, []), (7, 1, [1e30, -1e30])]
    got = zone_negatives.mine(spark.createDataFrame(rows, schema)).collect()
    one = [(r.rank, r.negative_id) for r in got if (r.anchor_id, r.positive_id) == (0, 1)]
    assert one == [(1, 3), (2, 4), (3, 5)]  # equal scores by id; a dimension more counts with 0
    assert {r.anchor_id for r in got} == {0}
    assert zone_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert zone_negatives.mine(spark.createDataFrame([(1, 1, [1.0])], schema)).count() == 0
    assert zone_negatives.mine(spark.createDataFrame([(0, 1, [1.0])], schema)).count() == 0
    big = np.array([[2**40, 3]]), np.array([[2**20, -5]])
    assert zone_negatives.products(*big).tolist() == [[2**60 - 15]]


# --- 12 --------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    import math
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    counts = [Counter(w) for _, w in held]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, w), c in zip(held, counts, strict=True):
            if not w:
                continue
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    """Skewed words, copies (ties), a very long text, nulls, repeated ids, several blocks of items and buckets."""
    if small:
        for name, value in (("BLOCK_ITEMS", 4), ("BLOCK_TERMS", 60), ("BUCKET", 16), ("HEAD", 0.2)):
            monkeypatch.setattr(lexical, name, value)
    r = np.random.default_rng(3)
    word = lambda: f"W{min(int(r.zipf(1.3)), 4000)}é"
    docs = [(i, " ".join(word() for _ in range(int(r.integers(1, 60))))) for i in range(400)]
    docs += [(1000 + i, "W1é W7é, w9é Zz") for i in range(30)] + [(7, "w7é w7é"), (7, "w7é w7é"), (None, "W1é W7é, w9é Zz"), (2000, None), (2001, ""), (2002, "--- \n")]
    docs += [(3000, " ".join(f"l{i % 977}" for i in range(400_000)) + " zz")]
    items = [(i, " ".join(word() for _ in range(20))) for i in range(15)] + [(90, "w7é W1É w1é w9é zz"), (90, "zz"), (91, None), (92, "!!"), (93, "neverseen"), (None, "w9é l5")]
    d = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, _row string, terms int")
    b = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item int, rank int")
    got = lexical.search_items(d, b).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items)


def test_search_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search_items(d.limit(0), b).count() == 0 and lexical.search_items(d, b.limit(0)).count() == 0
    assert lexical.search_items(d, b).count() == 1


def test_norm_buckets_leave_vectors_out():
    """Documents whose length or focus coordinates cannot reach a score are never scored."""
    block = lexical.Block([(0, np.arange(1, 9, dtype=np.uint64))])
    block.weigh(1000, 50_000, np.array([1, 2, 3, 5, 8, 400, 600, 900]))
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(8, 2 + int(d > 40) + 5 * int(d < 3), replace=False)) for d in range(80)]
    impacts = [np.full(len(t), 800_000) for t in rows]
    length = np.array([np.sqrt((block.weight[t] * i.astype(float) ** 2).sum()) for t, i in zip(rows, impacts, strict=True)])
    order = np.argsort(-length, kind="stable")
    bounds = np.cumsum([0] + [len(rows[o]) for o in order])
    bucket = lexical.Bucket(block, order, np.zeros(80, bool), length[order], bounds, np.concatenate([rows[o] for o in order]), np.concatenate([impacts[o] for o in order]))
    number = np.empty(8, np.int64)
    number[block.terms[0]] = np.arange(8)
    exact = bucket.scores(0, np.arange(80), np.zeros(8, np.int64))
    assert exact.tolist() == [int((block.weight[rows[o]] * 800_000).sum()) for o in order]
    least = int(np.sort(exact)[-3])
    left = bucket.candidates(0, least)
    assert set(np.flatnonzero(exact >= least)) <= set(left.tolist()) and len(left) < 40


# --- 13 --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, row string, sha int, first_id int"


def written(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], PAGES)
    return warc.write_archives(pages, scratch_path(spark, "warc-test"), **options)


def test_archive_round_trip_and_cases(spark):
    rows = [(5, "http://a/ b\r\nX-Evil: 1", "<p>hällo</p>"), (3, None, "<p>hällo</p>"), (None, "u", "<p>hällo</p>"), (9, "u", None), (8, "u", ""), (4, "u", "x" * 3_000_000),
            (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "twice"), (7, "u", "twice")]
    manifest = written(spark, rows)
    got = sorted((tuple(r) for r in warc.read_archives(manifest).select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=str)
    assert got == sorted([(5, "revisit", 3, 13), (3, "response", None, 13), (None, "revisit", 3, 13), (9, "revisit", 8, 0), (8, "response", None, 0),
                          (4, "response", None, 3_000_000), (6, "response", None, 14), (7, "response", None, 5), (7, "revisit", 7, 5)], key=str)
    fields = {}
    for (path,) in manifest.select("path").distinct().collect():
        records = list(warc.read_file(path))
        assert records[0][0]["warc-type"] == "warcinfo"
        for f, block in records[1:]:
            fields.setdefault(f.get("x-page-id"), []).append((f, block))
    assert "x-evil" not in fields["5"][0][0] and fields["5"][0][0]["warc-target-uri"] == "http://a/%20b%0D%0AX-Evil:%201"
    assert fields["3"][0][0]["warc-target-uri"] == "urn:page:3" and fields["3"][0][1].endswith("<p>hällo</p>".encode())
    assert fields["5"][0][0]["warc-refers-to"] == fields["3"][0][0]["warc-record-id"]
    assert len({f["warc-record-id"] for x in fields.values() for f, _ in x}) == len(rows)
    assert warc.read_archives(written(spark, [], date="2020-01-01T00:00:00Z")).count() == 0


def test_small_payloads_can_stay_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r.page_id: r.record_type for r in warc.read_archives(written(spark, rows, least_bytes=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_heavy_and_rare_payloads_agree(spark):
    rows = spark.createDataFrame([(i, 1000 - i, "u", "same" if i % 3 else f"p{i // 6}", 0) for i in range(900)], "row long, page_id long, url string, html string, x int")
    rows = rows.selectExpr("row", "page_id", "url", "html", "sha1(html) AS sha", "cast(octet_length(html) AS long) AS n_bytes")
    all_heavy, none_heavy = (sorted(map(tuple, warc.with_first(rows, heavy_share=s).collect())) for s in (0.001, 2.0))
    assert all_heavy == none_heavy and len(all_heavy) == 900 and sum(r[7] is None for r in all_heavy) == 151


def test_dictionary_frame_and_frames_of_their_own(spark):
    rows = [(i, f"http://h/{i}", "<html><head><title>page of the shop</title></head><body>" + f"item {i * 7919 % 1000} " * 20) for i in range(600)]
    manifest = written(spark, rows, date="2020-01-01T00:00:00Z")
    path = manifest.first()["path"]
    fs, name = warc.file_system(path)
    with fs.open_input_file(name) as handle:
        data = handle.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0 and zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id()
    # any zstd reader given the dictionary reads the rest; a frame alone is a whole record
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n")
    with fs.open_input_file(name) as handle:
        dictionary, at = warc.read_dictionary(handle)
        records = list(warc.records_of(handle, at, len(data) - at, dictionary))
    assert len(plain) == sum(len(zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(f)) for f in frames(data[at:], dictionary))
    without = sum(len(zstandard.compress(b)) for _, b in records)
    assert len(data) - 8 - size < without  # the dictionary pays
    broken = data[:-3]
    with pytest.raises(ValueError):
        list(warc.records_of(pa.BufferReader(broken), at, len(broken) - at, dictionary))


def frames(data, dictionary):
    while data:
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        d.decompress(data)
        yield data[: len(data) - len(d.unused_data)]
        data = d.unused_data
