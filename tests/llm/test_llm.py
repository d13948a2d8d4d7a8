"""Operators against brute force, exact round trips and held-out accuracy, and
their defined cases: nulls, empty texts, ties, repeated rows, empty tables,
extra columns with clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderlens.llm import chat, common, decontaminate, hash_index, language_id, near_dedup, packing, prefix_free, quality, suffix_tree_lm, token_files, tokens
from orderlens.session import scratch_path
from orderlens.verify import duckdb_con

SF = "/root/testdata/sf0.001"
LOW = {k: k + 32 for k in range(65, 91)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, _row string, _text long, block string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, a very long text, copies and near copies, one id twice."""
    words = [f"w{i * 7919 % 1000}" for i in range(120)]
    near = words[:118] + ["x", "y"]
    long = " ".join(f"l{i * 31 % 5003}" for i in range(60_000))
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (3, " ".join(words)), (4, None), (5, ""), (None, "a b"),
            (6, long), (7, "***"), (8, "***"), (9, "short"), (10, "ÉTÉ <|endoftext|> 10's 00")]
    return spark.createDataFrame([(i, t, "r", 1, "b", "en") for i, t in rows], DOCS)


def oracle(name, sql):
    con = duckdb_con(SF)
    cur = con.execute(sql)
    return [d[0] for d in cur.description], sorted(map(tuple, cur.fetchall()), key=str)


# --- 1 ---------------------------------------------------------------------------------


def test_decontaminate_matches_sql(spark):
    names, rows = oracle("op1", decontaminate.ORACLE)
    got = decontaminate.op1_decontaminate(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == rows


def test_decontaminate_shuffled_path_and_cases(spark, awkward):
    items = spark.createDataFrame([(1, " ".join(f"w{i * 7919 % 1000}" for i in range(20, 40))), (1, "short"), (2, None), (3, "..."), (None, "a b")], "item_id long, text string")
    for limit in (1 << 24, 0):
        got, _ = decontaminate.contamination(awkward, items, broadcast_bytes=limit)
        rows = {(r.doc_id, r.n_words): r for r in got.collect()}
        assert got.count() == 12
        assert rows[1, 120].n_hit == 20 and rows[1, 120]["items"] == ["1"] and rows[1, 120].contaminated
        assert rows[9, 1].n_hit == 1 and rows[None, 2].n_hit == 2 and rows[None, 2].n_items == 0
        assert not rows[4, 0].contaminated and not rows[6, 60_000].contaminated
    assert decontaminate.remove_contaminated(awkward, items.limit(0)).count() == 12
    kept = decontaminate.remove_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.where("doc_id in (1, 2, 3, 9)").count() == 0
    empty, _ = decontaminate.contamination(awkward.limit(0), items)
    assert empty.count() == 0


# --- 2 and 8 -----------------------------------------------------------------------------


def test_chunk_encoder_equals_library(texts):
    encode = tokens.ChunkEncoder(tokens.tokenizer_path(), max_chunks=3000)
    own = [*texts.values(), "", "a 0 b00 <|endoftext|>x", "́a \x1cé 'S ﬁ①", "İ Σς", " \n"]
    data = np.frombuffer("".join(own).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in own])
    got = list(encode.batches(data, offsets))
    ids, counts = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    ends = np.cumsum(counts)
    for t, a, b in zip(own, ends - counts, ends):
        assert ids[a:b].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, awkward, docs, texts):
    encode = tokens.encoder(tokens.tokenizer_path()).tokenizer
    folder = scratch_path(spark, "files-test")
    manifest = token_files.write_token_files(docs, folder, frame_tokens=2000)
    start = 0
    rows = {r.doc_id: r for r in token_files.read_token_files(manifest).collect()}
    for i in sorted(texts):
        ids = np.array(encode.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = manifest.orderBy("file_no").first()["path"]
    first = min(texts)
    assert token_files.read_documents(path, {first})[first][0].tolist() == encode.encode(texts[first], add_special_tokens=False).ids + [1]
    odd = token_files.read_token_files(token_files.write_token_files(awkward, scratch_path(spark, "files-test"))).collect()
    assert len(odd) == 12 and {r.n_tokens for r in odd if r.doc_id in (4, 5)} == {1} and [r.start for r in odd if r.doc_id is None] == [0]
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), scratch_path(spark, "files-test"))).count() == 0


def test_packing(spark, docs, awkward):
    rows = packing.pack(docs, keep_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 2
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows.itertuples())
    assert packing.sequences(packing.pack(awkward, keep_ids=True)).count() > 1
    assert packing.pack(awkward).where("doc_id in (4, 5)").agg({"length": "sum"}).first()[0] == 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_bin_completion_small_optimum():
    counts = np.zeros(11, np.int64)
    for k in (6, 6, 5, 5, 4, 4, 3, 3, 2, 2):  # 40 in all: four full sequences of 10
        counts[k] += 1
    out = packing.pack_histogram(counts)
    assert sum(n for _, n in out) == 4 and all(sum(p) <= 10 for p, _ in out)
    assert Counter(k for p, n in out for k in p * n) == Counter({6: 2, 5: 2, 4: 2, 3: 2, 2: 2})


def test_bin_search_above_forty_pieces():
    """The same pieces once and many times over: 3 sequences each, at any size."""
    for times in (1, 6, 1000):
        counts = np.zeros(101, np.int64)
        np.add.at(counts, [60, 49, 49, 39, 31, 31, 20, 20], times)
        for out in (packing.pack_histogram(counts), packing.best_fit_decreasing(counts)):
            assert Counter({k: int(counts[k]) for k in np.flatnonzero(counts).tolist()}) == sum((Counter({k: c * n for k, c in Counter(p).items()}) for p, n in out), Counter())
            assert all(sum(p) <= 100 for p, _ in out)
        assert packing.lower_bound(counts) == -(-299 * times // 100) <= sum(n for _, n in packing.pack_histogram(counts)) <= 3 * times


# --- 3 ---------------------------------------------------------------------------------


def test_suffix_tree_base_scores_and_gain(spark, docs, texts):
    rows = {r.doc_id: r for r in suffix_tree_lm.score_texts(docs).collect()}
    own = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) + [0] for i, t in texts.items()}
    train = {i for i in own if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in train for w in own[i])
    n, v = sum(c.values()), len(c)
    for i, words in own.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_suffix_tree_states_add_to_one(spark):
    rows = [(i, "a b c " * 30 + "a d e " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, tree = suffix_tree_lm.train(suffix_tree_lm.to_blocks(suffix_tree_lm._prepared(df, "doc_id", "text"), "text"))
    assert len(tree.states)
    vocabulary = "abcde"
    hashes = np.append(suffix_tree_lm.tokens(np.frombuffer(b"a b c d e", np.uint8), np.array([0, 9]))[0][:5], suffix_tree_lm.END)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t.split())
    known = np.array([counts[w] for w in vocabulary] + [len(train), 0])
    symbols = np.append(hashes, np.uint64(12345))  # and one unknown word
    for state in [-1, *range(len(tree.states))]:
        p = 10 ** tree.score(np.full(len(symbols), state), symbols, tree.root_probability(known))
        assert abs(p.sum() - 1) < 1e-9


def test_suffix_tree_cases(spark, awkward):
    rows = suffix_tree_lm.score_texts(awkward).collect()
    assert len(rows) == 12 and {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {1} and all(r.score <= 0 for r in rows)
    assert suffix_tree_lm.score_texts(awkward.limit(0)).count() == 0


def brute_suffix_tree(texts, held):
    """Scores by plain dictionaries: contexts of any length, the longest retained suffix."""
    least, discount = suffix_tree_lm.MIN_COUNT, suffix_tree_lm.DISCOUNT
    own = {i: t.split() + [None] for i, t in texts.items()}
    words = Counter(w for i in own if i not in held for w in own[i])
    n, ones, twos = sum(words.values()), *(sum(c == k for c in words.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else discount
    states: dict = {}

    def probability(context, symbol):
        for k in range(len(context) + 1):
            if context[k:] in states:
                entries, left = states[context[k:]]
                return entries[symbol] if symbol in entries else left * probability(context[k + 1 :], symbol)
        return (words[symbol] - d) / n if words[symbol] else d * len(words) / n

    depth, deepest = 0, 0
    while True:
        depth += 1
        follow: dict = {}
        for i in own:
            for at in range(depth, len(own[i]) if i not in held else 0):
                follow.setdefault(tuple(own[i][at - depth : at]), Counter())[own[i][at]] += 1
        new = {}
        for context, c in follow.items():
            total, often = sum(c.values()), {s: m for s, m in c.items() if m >= least}
            if not often:
                continue
            entries = {s: (m - discount) / total for s, m in often.items()}
            shorter = {s: probability(context[1:], s) for s in often}
            left, left_shorter = max(1 - sum(entries.values()), 1e-12), max(1 - sum(shorter.values()), 1e-12)
            gain = sum(p * math.log(p / shorter[s]) for s, p in entries.items()) + left * math.log(left / left_shorter)
            if total * gain > 0.5 * math.log(n) * (len(entries) + 1):
                new[context] = entries, left / left_shorter
        if not new:
            return {i: sum(math.log10(probability(tuple(w[max(0, k - deepest) : k]), s)) for k, s in enumerate(w)) for i, w in own.items()}, deepest
        states |= new
        deepest = depth


def test_suffix_tree_any_depth_matches_brute_force(spark, monkeypatch):
    """A word that depends on all of the four words before it: contexts of four words are retained."""
    r = np.random.default_rng(2)
    texts = {}
    for i in range(60):
        x = ["".join(k) for k in r.choice(["p", "q"], (30, 4))]
        texts[i] = " ".join(" ".join(k) + f" {k}" + (f" z{i}" if r.random() < 0.2 else "") for k in x)
    monkeypatch.setattr(suffix_tree_lm, "PER_BUCKET", 50)  # several buckets
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in suffix_tree_lm.score_texts(df).collect()}
    want, deepest = brute_suffix_tree(texts, {i for i in got if got[i].held_out})
    assert deepest >= 4 and all(abs(got[i].score - want[i]) < 1e-6 * abs(want[i]) for i in texts)


def test_suffix_tree_counts_at_any_size(spark, monkeypatch):
    """What is counted is the same for a corpus that other texts make much larger."""
    monkeypatch.setattr(suffix_tree_lm, "PER_BUCKET", 100_000)
    text = "red fox jumps over"
    train = [i for i in range(20) if zlib.crc32(str(i).encode()) % 10][: suffix_tree_lm.MIN_COUNT]
    rows = [(i, text) for i in train] + [(100 + i, " ".join(f"u{(i * 50_021 + k) % 4_800_000}" for k in range(50_000))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, levels, tree = suffix_tree_lm.train(suffix_tree_lm.to_blocks(suffix_tree_lm._prepared(df, "doc_id", "text"), "text"))
    fox = suffix_tree_lm.tokens(np.frombuffer(b"fox", np.uint8), np.array([0, 3]))[0][:1]
    assert tree.root["N"] > 4_300_000 and levels >= 1 and suffix_tree_lm._lookup(tree.states, suffix_tree_lm.mix(fox, 31))[0] >= 0


def test_suffix_tree_levels_move_no_states(spark):
    """The join of the states with the answers shuffles the answers alone, whatever the number of files."""
    rows = [(i, "a b c " * 30 + "a d e " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    states, _, _ = suffix_tree_lm.train(suffix_tree_lm.to_blocks(suffix_tree_lm._prepared(df, "doc_id", "text"), "text"), keep_tree=False)
    for n in (5, 16):
        bucketed = common.write_bucketed(states, "states", n)
        told = suffix_tree_lm._collected(spark.createDataFrame([(0, 0, b"")], suffix_tree_lm.MESSAGE).repartition(n, "block"), "told")
        plan = bucketed.join(told.hint("merge"), "block", "left")
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and plan.count() == states.count()


def test_suffix_tree_distinct_by_a_plain_sort():
    r = np.random.default_rng(3)
    for values in (r.integers(0, 50, 1000).astype(np.uint64), r.integers(0, 2**64 - 1, 1000, np.uint64), np.empty(0, np.uint64)):  # high bits equal; not; none
        for got, want in zip(suffix_tree_lm._distinct(values), np.unique(values, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all()
    for top in (40, 2**45):  # the pairs fit 64 bits with their places, or don't
        a, b = r.integers(0, 4, 500), r.choice([0, 1, top], 500)
        first, number = suffix_tree_lm._distinct_pairs(a, b)
        pairs = list(zip(a[first].tolist(), b[first].tolist(), strict=True))
        assert pairs == sorted(set(zip(a.tolist(), b.tolist(), strict=True))) and (a[first][number] == a).all() and (b[first][number] == b).all()


def test_suffix_tree_sorts_small_numbers_and_pairs_without_an_argsort(monkeypatch):
    """Numbers of words, pairs of them and scores, of which the old code sorted places."""
    r = np.random.default_rng(5)
    number = r.integers(0, 1 << 20, 5000).astype(np.uint64)
    scores = np.log10(r.integers(1, 300, 5000) / 7e5)
    wanted = [np.unique(x, return_index=True, return_inverse=True) for x in (number, number << np.uint64(32) | number[::-1])]
    monkeypatch.setattr(np, "unique", None)
    for x, want in zip((number, number << np.uint64(32) | number[::-1]), wanted, strict=True):
        for got, own in zip(suffix_tree_lm._distinct(x), want, strict=True):
            assert (got == own).all()
    coded, at = suffix_tree_lm._decoded(*suffix_tree_lm._coded(scores), np.float64)
    assert (coded[at] == scores).all() and len(coded) == len(set(scores.tolist()))
    code = r.integers(0, 40, 3000)  # of a dictionary with repeats and values that are not used
    coded, at = suffix_tree_lm._decoded(*suffix_tree_lm._coded(number[:60] % np.uint64(9), code))
    assert (coded[at] == number[code] % np.uint64(9)).all() and len(coded) == len(set(coded.tolist()))


def test_suffix_tree_takes_few_tokens_through_all_levels_in_one_task(spark, monkeypatch):
    """A text that occurs often has a level for each of its words; the scores are the same to the last bit."""
    r = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 30, n))
    often = " ".join(f"v{x}" for x in range(12)) + " " + " ".join(r.permutation([f"v{x % 6}" for x in range(18)]))
    rows = [(k, f"{word(9)} {often if k % 3 else word(30)} {word(5)}") for k in range(120)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    levels, tails = [], []
    level, last = suffix_tree_lm._level, suffix_tree_lm._last_levels
    monkeypatch.setattr(suffix_tree_lm, "_level", lambda *a: levels.append(a[1]) or level(*a))
    monkeypatch.setattr(suffix_tree_lm, "_last_levels", lambda *a: tails.append(last(*a)) or tails[-1])
    got = {}
    for most in (suffix_tree_lm.TAIL_TOKENS, 0):
        levels.clear()
        monkeypatch.setattr(suffix_tree_lm, "TAIL_TOKENS", most)
        got[most] = sorted(map(tuple, suffix_tree_lm.score_texts(df).collect()), key=str), len(levels)
    (one, n_one), (many, n_many) = got.values()
    assert one == many and len(one) == 122
    assert n_one == 1 and n_many > 2 and len(tails) == 1 and tails[0][1] == n_many - 1


def test_suffix_tree_message_needs_no_more_room_for_more_buckets():
    """Messages carry numbers of words and counts: a block's do not grow with the number of buckets that the corpus has."""
    r, s, n = np.random.default_rng(4), suffix_tree_lm.BlockState(), 200_000
    s.dictionary, s.code = np.arange(1, 5002, dtype=np.uint64), np.minimum(r.zipf(1.3, n), 5000)
    s.frequent, s.closed, s.held, s.held_out, s.total = np.ones(n, bool), np.zeros(n), np.array([n]), np.array([False]), np.zeros(1)
    root = {"N": n, "V": 5001, "D": 0.5}
    s.reach(1)
    s.settle(np.log10(suffix_tree_lm._root_probability(root, 8 + 9_000 // (1 + s.code))), np.zeros(0))
    few, many = (sum(len(m) for _, m in s.messages(1, k, True, root)) for k in (2, 16))
    assert many < 1.3 * few


# --- 4 and 10 ----------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs, "doc_id")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.95
    rows = {r.doc_id: r for r in language_id.identify(awkward).collect()}
    assert rows[4].lang_pred == rows[5].lang_pred == rows[7].lang_pred == "und" and rows[4].score == 0
    assert language_id.identify(awkward.limit(0)).count() == 0


def test_quality_held_out_accuracy(spark, awkward):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    assert got.where("predicted = quality").count() / got.count() > 0.97
    assert {r.score for r in quality.score_documents(awkward, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and quality.keep_good(awkward.limit(0), labels).count() == 0


def test_quality_sample_takes_one_row_an_id(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = spark.createDataFrame([(ids[0], f"text {k}") for k in range(50)] + [(i, f"other {i}") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    _, bag, y = quality.sample_bags(docs, labels, max_docs=4)
    assert y.tolist() == [0, 1, 0, 1] and bag.tolist() == [0, 1, 2, 3] and quality.train(docs, labels, 4) is not None


# --- 5 ---------------------------------------------------------------------------------


def test_nearest_recall_and_exact_round(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    want = {}
    for q in (i for i in x if i % 100 == 0):
        near = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        want[q] = [(i, d) for d, i in near]
    for radius, least in ((None, 0.9), (0, 1.0)):  # nothing is found within 0 bits: all queries go to the exact round
        got = {}
        for r in hash_index.nearest(df, lambda i: i % 100 == 0, radius=radius).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hit >= least * sum(map(len, want.values()))
        if radius == 0:
            assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_nearest_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 2.0]), (8, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, block string")
    got = hash_index.nearest(df, lambda i: i % 100 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 8)]
    assert hash_index.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0


# --- 6 ---------------------------------------------------------------------------------


def _links(own):
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or Counter([tuple(w)] if w else []) for i, w in own.items()}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i].keys() & sets[j].keys())
                s = both / (len(sets[i]) + len(sets[j]) - both)
                if 0.2 < s < 0.8:
                    keys = list(sets[i].keys() | sets[j].keys())
                    s = max(s, near_dedup.probability_jaccard(*(np.array([float(sets[x][g]) for g in keys]) for x in (i, j))))
                if s >= 0.8:
                    yield i, j


def test_near_classes_match_brute_force(spark, docs, texts):
    own = {i: re.findall(WORD, t.translate(LOW)) for i, t in texts.items()}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in _links(own):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    for r in near_dedup.near_classes(docs).collect():
        assert r.class_id == root(r.doc_id)


def test_probability_jaccard_and_sketch_agree():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, 400).astype(float), r.integers(0, 4, 400).astype(float)
    b[:300] = a[:300]
    keep = (a > 0) | (b > 0)
    a, b = a[keep], b[keep]
    direct = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in range(len(a)) if a[d] and b[d])
    assert abs(near_dedup.probability_jaccard(a, b) - direct) < 1e-12
    names = r.integers(1, 2**63, len(a)).astype(np.uint64)
    row = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
    found = near_dedup.prob_min_hash(row, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((found[0] == found[1]).mean() - direct) < 0.04


def test_near_chain_in_a_large_bucket(spark):
    """Many variants of one text, linked only through their neighbours."""
    r = np.random.default_rng(4)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for k in range(40):
        words = list(base)
        for at in r.choice(400, 4 + k % 9, replace=False):
            words[at] = f"n{k}x{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = {i: t.split() for i, t in rows}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in _links(own):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {x.doc_id: x.class_id for x in near_dedup.near_classes(df).collect()} == {i: root(i) for i in own}


def test_near_copies_with_a_repeated_line(spark):
    """Copies whose last line stands 100 times: plain Jaccard 0.98 or more,
    probability Jaccard far under the threshold; in small and in large buckets."""
    r = np.random.default_rng(6)
    rows = []
    for k in range(24):
        words = [f"s{k}x{i}" for i in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[-10:] * 99))]
    base = [f"h{i}" for i in range(300)]
    for k in range(30):  # one family: every text near to the others in plain Jaccard
        words = list(base)
        words[int(r.integers(0, 280))] = f"v{k}"
        rows.append((100 + k, " ".join(words + words[-10:] * (99 if k % 2 else 0))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(df).collect()}
    assert got == {i: i - i % 2 if i < 100 else 100 for i, _ in rows}


def test_near_sketches_spare_plain_links():
    """Two chunks of a large bucket that share only a band of the plain signature."""
    words = " ".join(f"s{i}" for i in range(300))
    repeated = words + " " + " ".join([f"s{i}" for i in range(290, 300)] * 99)
    batch = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array([0, 1]), near_dedup.pa.array([0, 1]), near_dedup.pa.array([words, repeated]), near_dedup.pa.array([5, 6])],
                                                  names=["_row", "_id", "_text", "_hash"])
    signed = near_dedup.pa.Table.from_batches(list(near_dedup._sign(iter([batch]))))
    data, offsets = near_dedup.text_buffer(batch.column(2))
    row, gram, weight, _, _ = near_dedup.shingles(data, offsets)
    body = [near_dedup._packed(gram[row == k], weight[row == k]) for k in (0, 1)]
    shared = set(signed["bands"][0].as_py()) & set(signed["bands"][1].as_py())
    sides = [near_dedup.pa.table({"bucket": [min(shared)], "node": [k], "component": [k], "body": [body[k]], **{c: signed[c].slice(k, 1) for c in ("sketch", "bins", "heavy", "bands")}}) for k in (0, 1)]
    assert near_dedup._compare(*sides, near_dedup.THRESHOLD).num_rows == 1


def test_near_sketches_lose_no_more_than_bands():
    def below(n, share):
        return sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(math.ceil(share * n)))

    lost = below(near_dedup.REGISTERS, near_dedup.LEAST_SKETCH) + below(near_dedup.BINS, near_dedup.LEAST_BINS)
    assert lost <= (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS


def test_near_cases(spark, awkward):
    rows = near_dedup.near_classes(awkward).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(classes[1]) == [1, 2, 3, 3] and sorted(classes[7]) == [7, 8] and classes[4] == [4] and classes[5] == [5]
    kept = near_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert near_dedup.near_classes(awkward.limit(0)).count() == 0 and near_dedup.keep_one(awkward.limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(prefix_free, "PER_BUCKET", 2000)  # several buckets
    got = prefix_free.repeat_digests(docs.repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(sorted(texts.items()))


def test_repeats_hot_passage_and_cases(spark, awkward):
    r = np.random.default_rng(9)
    passage = "shared passage " * 3 + "".join(map(chr, r.integers(97, 123, 150)))
    rows = [(i, "".join(map(chr, r.integers(97, 123, 90))) + passage + "".join(map(chr, r.integers(97, 123, 90)))) for i in range(60)]
    rows += [(100, "a" * 500), (101, "a" * 99), (102, "é" * 300), (103, None), (104, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, prefix_free.repeat_digests(df).collect()), key=str) == brute_repeats(rows)
    out = prefix_free.remove_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == 12 and out.where("text is null").count() == 1
    assert prefix_free.repeat_digests(awkward.limit(0)).count() == 0 and prefix_free.remove_repeats(awkward.limit(0)).count() == 0


# --- 9 ---------------------------------------------------------------------------------


def test_chat_matches_sql(spark):
    names, rows = oracle("op9", chat.ORACLE)
    assert sorted(map(tuple, chat.op9_chat_format(spark, SF).select(*names).collect()), key=str) == rows


def test_chat_cases(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    long = [(9, t, "user", f"t{t}") for t in range(300)]
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 5, "user", "a"), (3, 6, "assistant", "b"),
            (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "z"), (6, None, None, "q"), *long, *[(10, *r[1:]) for r in long[:290]]]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, place int, part string")
    got = {(r.conv_id, r.part): r for r in chat.render(df).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (None, 0), (6, 0), (9, 0), (9, 1)}
    assert got[2, 0].n_snapshots == 3 and got[2, 0].text == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    assert got[9, 1].n_snapshots == 2 and got[9, 1].text.count("<|end|>") == 44
    assert chat.render(df.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), docs.schema)
        assert frame.columns == docs.columns
        seen.append(frame.count())
    assert seen == sorted(seen, reverse=True) and seen[1] == seen[2] and seen[-1] > docs.count() // 2
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == seen[-1]
