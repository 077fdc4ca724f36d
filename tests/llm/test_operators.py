"""Every operator against a plain version on small inputs with the awkward rows: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns whose names clash with results."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, licenses, minhash, mixing, preferences, quality, secrets, suffix, tokens, vectors
from tidemark.llm import _graph
from tidemark.llm._graph import components
from tidemark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, kept boolean, score string, n_words string, unit int"


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=1):
    """Near copies in chains and groups, exact copies, and the awkward rows."""
    rng = random.Random(seed)
    rows, base = [], [words_text(rng, rng.randrange(20, 90)) for _ in range(12)]
    for text in base:
        rows.append(text)
        for _ in range(rng.randrange(0, 5)):
            w = text.split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += [base[0], base[0].upper(), None, "", "  \t ", "one two", "one two", "a b c d e", "é" * 70 + " naïve", "x " * 30, "x " * 30]
    rows.append(words_text(rng, 20_000, 5000))
    out = [(i, t, f"s{i % 3}" if i % 7 else None, None, "x", "y", 1) for i, t in enumerate(rows)]
    return out + [out[3], (None, base[1], "s1", True, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_near(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if i is not None:
            sets[i] = s
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


@pytest.mark.parametrize("limits", [{}, {"LEAF": 2, "GROUP_DOCS": 3}])
def test_near_duplicates(docs, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(minhash, k, v)
    sets, root = plain_near(awkward_rows())
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("limits", [{}, {"SMALL_EDGES": 0}, {"SMALL_EDGES": 0, "LEAST_HUB": 3, "HUBS": 40}])
def test_components(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(_graph, k, v)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(900, 900 + k) for k in range(1, 50)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = roots({x for e in links if e[0] != e[1] for x in e}, links)
    assert got == want


def test_recall_of_the_trees(spark):
    """Pairs just over the threshold, all of them among many documents that resemble them just below it."""
    rng = random.Random(15)
    own = lambda k: [f"r{rng.randrange(10**9)}" for _ in range(k)]
    rows, pairs = [], 400
    common = own(66)
    for i in range(pairs):
        mine = own(20)  # two documents share some 76 of 100 shingles, and with all others some 55
        for side in range(2):
            w = common + mine + own(13)
            rows.append((2 * i + side, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = plain_near(rows)
    linked = sum(root[2 * i + 1] == 2 * i for i in range(pairs))
    assert linked > 350 and sum(got[2 * i + 1] == root[2 * i + 1] for i in range(pairs)) >= pairs - 1


def test_a_repeated_id_ties_its_sets(spark):
    rng = random.Random(16)
    a, b, c = (words_text(rng, 30) for _ in range(3))
    rows = [(1, a), (2, b), (3, a), (3, b), (4, c), (5, c), (5, a), (6, None)]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 1), (5, 1), (6, 6)]


def plain_repeats(rows, window=50):
    seen, out = {}, {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        for k in range(len(b) - window + 1):
            seen.setdefault(b[k : k + window], i)
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - window + 1):
                if seen[b[k : k + window]] < i:
                    gone[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, text)] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"SHARD_BYTES": 300}, {"SHARD_BYTES": 700, "WARM": 2, "HOT_CONTEXTS": 5}, {"WARM": 1, "HOT_CONTEXTS": 0, "STEP": 1}])
def test_remove_repeats(spark, monkeypatch, limits):
    for k, v in limits.items():  # shards that must merge; minimisers whose windows are dealt out
        monkeypatch.setattr(suffix, k, v)
    rng = random.Random(4)
    line = words_text(rng, 25)
    rows = [(i, f"{words_text(rng, rng.randrange(3, 30))}\n{line[: rng.randrange(40, len(line))]} {words_text(rng, 9)}") for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]] + [(200, "ab" * 200), (201, "ab" * 100), (202, None), (203, ""), (204, "é" * 60), (205, "é" * 60), (7, line), (7, rows[7][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(df, with_text=True).collect()
    want = plain_repeats(rows)
    assert len(got) == len(rows)
    left = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert left == sorted((i or -1, *want[(i, t)]) for i, t in rows)


def test_removal_is_what_the_arrays_say(spark, monkeypatch):
    text = words_text(random.Random(14), 60)
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix.remove_repeats(df).collect()) == [0, *[len(text)] * 4]
    monkeypatch.setattr(suffix, "merged_least", lambda shards: [np.full(len(x.least), 1 << 40) for x in shards])
    work = suffix._bucket(50)  # without the merged order nothing goes
    row = {"bucket": [0, 0], "unit": [1, 2], "marks": [], "lengths": [bytes([60])] * 2, "bytes": [suffix._squeeze(text.encode()[:60])] * 2}
    row["marks"] = [suffix._squeeze(np.array([d, 9, 0, 0], np.int64).tobytes()) for d in (3, 4)]
    row["next"] = [suffix._squeeze(np.array([5], np.int64).tobytes())] * 2  # both units hold the context again, in document 5
    row["others"] = [None, suffix._pack(*np.array([[5], [9], [0], [60]]))]
    assert work((), pa.table(row)).num_rows == 0
    monkeypatch.undo()
    got = [(u, suffix._unpack(m).tolist()) for u, m in zip(*(work((), pa.table(row)).column(c).to_pylist() for c in ("unit", "marks")))]
    assert sorted(got) == [(2, [[4], [9], [0], [60]]), (2, [[5], [9], [0], [60]])]


def test_merged_shards():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7):
        texts = [rng.integers(97, 99, 60 + 20 * k).astype(np.uint8) for k in range(n)]
        shards = [suffix._Shard(t, np.array([30, len(t) - 30]), np.array([5 * k + 1, 5 * k]), 12) for k, t in enumerate(texts)]
        least = {}
        for k, t in enumerate(texts):
            for doc, part in ((5 * k + 1, t[:30]), (5 * k, t[30:])):
                for a in range(len(part) - 11):
                    w = part[a : a + 12].tobytes()
                    least[w] = min(doc, least.get(w, doc))
        for shard, low in zip(shards, suffix.merged_least(shards), strict=True):
            assert [least[w] for w in shard.strings.tolist()] == low.tolist() and sorted(shard.strings.tolist()) == shard.strings.tolist()


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 7, 200, 900):
        t = rng.integers(97, 99, n).astype(np.uint8)
        b = np.concatenate([t, t]).tobytes()
        order, _ = suffix.suffix_array(np.frombuffer(b, np.uint8), 50)
        assert all(b[x : x + 50] <= b[y : y + 50] for x, y in itertools.pairwise(order))
        prefix = suffix.common_prefixes(np.frombuffer(b, np.uint8), order, 50)
        for i in range(1, len(order)):
            x, y = b[order[i - 1] :][:50], b[order[i] :][:50]
            assert prefix[i] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_contamination(spark, docs):
    rng = random.Random(5)
    items = [("i2", words_text(rng, 30, 50)), ("i10", words_text(rng, 14, 50)), ("short", "Alpha beta"), ("one", "zzz"), ("none", "!!"), ("null", None), (None, "alpha")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    low = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = []
    for i in range(60):
        w = low(items[rng.randrange(2)][1])
        a = rng.randrange(len(w) - 3)
        own.append((i, f"{words_text(rng, 5)} {', '.join(w[a : a + rng.randrange(3, 30)]).upper()}. alpha {'Beta' if i % 2 else 'gamma'} {words_text(rng, 3)} {'ZZZ' if i % 5 == 0 else ''}"))
    own += [(100, None), (101, ""), (102, "zzz"), (3, own[3][1])]
    got = decontam.contamination(spark.createDataFrame(own, "doc_id long, text string"), bench).collect()
    want = []
    for i, t in own:
        w, hit, found = low(t), set(), set()
        for item, text in items:
            g = low(text)
            if item is None or not g:
                continue
            k = min(10, len(g))
            windows = {tuple(g[a : a + k]) for a in range(len(g) - k + 1)}
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(tuple(r) for r in got) == sorted(want)
    no_items = decontam.contamination(docs, bench.where("false"))
    assert no_items.where("contaminated or n_hit > 0").count() == 0 and no_items.count() == docs.count()


def test_contamination_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(str(i), words_text(rng, 15)) for i in range(9)]
    rows = [(i, f"{items[i][1]} {words_text(rng, 8)} {items[(i + 1) % 9][1]}") for i in range(9)]
    bench, df = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(decontam.contamination(df, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    assert sorted(decontam.contamination(df, bench).collect()) == once
    assert all(r.n_hit == 30 and r.n_items == 2 for r in once)


def test_decontaminate_cuts_spans(spark):
    passage = " ".join(f"b{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"Keep this, {passage}! And that", 7), (2, passage, 8), (3, "clean é text", 9), (4, None, 1)], "doc_id long, text string, hits int")
    got = {r.doc_id: r for r in decontam.decontaminate(df, spark.createDataFrame([("a", passage)], "item_id string, text string")).collect()}
    assert got[1].text == "Keep this, ! And that" and got[3].text == "clean é text" and got[4].text is None and 2 not in got and got[1].hits == 7


@pytest.mark.parametrize("tile", [1 << 21, 24 * 16])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 24))
    rows = [(i, [float(x) for x in (centre[i % 6] + rng.normal(size=24) * 0.25).astype(np.float32)], "x", 5) for i in range(150)]
    rows += [(200, None, "x", 1), (201, [0.0] * 24, "x", 1), (202, [1.0, None] + [0.0] * 22, "x", 1), (203, [float("nan")] * 24, "x", 1), (204, [1.0, 2.0], "x", 1), (205, [1.0, 2.0], "x", 1), (206, [], "x", 1), (None, rows[0][1], "x", 1)]
    rows += [(300 + i, rows[i % 2][1], "copy", 1) for i in range(40)] + [(301, rows[1][1], "again", 1), (400, [x * 2 for x in rows[5][1]], "scaled", 1)]
    rows += [(500, rows[0][1], "torn", 1), (500, rows[1][1], "torn", 1), (501, rows[0][1], "torn", 1), (501, rows[4][1], "torn", 1), (501, [3.0, 6.0], "torn", 1), (502, None, "x", 1), (502, rows[7][1], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string, n_links int").repartition(3)
    got = {}
    for r in vectors.near_vectors(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(good, 2) if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9}
    root = roots([i for i, *_ in rows if i is not None], links)
    assert len(links) > 100 and sum(map(len, got.values())) == len(rows)
    for i in {i for i, *_ in rows if i is not None}:
        assert set(got[i]) == {(sum(i in e for e in links), root[i], root[i] == i)}, i
        assert len(got[i]) == sum(j == i for j, *_ in rows)
    assert got[None] == [(0, None, True)]


def test_quantisation_bound():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 1500))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, s, e = vectors.quantise(v)
    near = vectors.tile_product(q, q) * s[:, None] * s[None]
    bound = e[:, None] * (1 + e) + (1 + e[:, None]) * e + e[:, None] * e
    assert (np.abs(near - v @ v.T) <= bound + vectors.SLACK).all()


def test_mix_keeps_all_and_stays_within_a_block(spark, docs):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else "c")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(df, weights, block_docs=4, period=50).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3000)) and sorted(r.doc_id for r in got) == list(range(3000))
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in slots.values())
    done = dict.fromkeys(weights, 0)
    last = {s: max(r.slot for r in got if r.source == s) for s in weights}
    for slot in range(min(last.values())):
        done[next(iter(slots[slot]))[0]] += 1
        for s, w in weights.items():
            assert abs(done[s] - (slot + 1) * w) < 1, (slot, s)
    assert got == mixing.mix(df, weights, block_docs=4, period=1000).orderBy("position").collect()
    awkward = mixing.mix(docs).collect()
    assert sorted(r.position for r in awkward) == list(range(docs.count()))


def test_names_that_clash_and_ids_that_are_missing(spark):
    mine = ["__row", "__position", "__key", "__hits", "__found", "__words", "a.b"]
    rows = [(i if i else None, f"text {i} " + "alpha beta " * (i % 3), None if i % 4 else "s", *["mine"] * len(mine)) for i in range(-1, 30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *mine])
    mixed = mixing.in_mixed_order(df)
    assert mixed.columns == df.columns and sorted(map(str, mixed.collect())) == sorted(map(str, df.collect()))
    items = spark.createDataFrame([("x", "alpha beta"), ("y", "text 7")], "item_id string, text string")
    clean = decontam.decontaminate(df, items, max_coverage=1.0)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert {tuple(r[c] for c in mine) for r in clean.collect()} == {("mine",) * len(mine)}
    assert all("alpha" not in r.text for r in clean.collect())
    found = decontam.scan(df, items)
    assert found.columns == [*df.columns, "___words", "___hits", "___found"]
    ids = {r.doc_id: r.n_tokens for r in tokens.token_records(df.where("doc_id is null or doc_id = -1"), tokenizer_path()).collect()}
    assert set(ids) == {None, -1}


def test_training_takes_one_row_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Additive, "fit", lambda self, x, y: seen.append((len(x), y.tolist())) or self)
    docs = spark.createDataFrame([(3, f"one of many texts {i}") for i in range(2000)] + [(i, "another") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0)], "doc_id long, quality int")
    quality.train(docs, labels, rows=10)
    quality.train(docs.repartition(7), labels, rows=10**6)
    known = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen[0][0] <= 10 and seen[1][0] == len(known)


def test_pairs_with_columns_of_their_own(spark):
    turns = preferences.turns_of(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c")], "conv_id long, turn long, role string, text string"))
    pairs = spark.createDataFrame([(1, 2)], "chosen long, rejected long")
    more = pairs.selectExpr("chosen", "rejected", "7 AS turn", "'x' AS digest", "1 AS conv", "'s' AS side", "2 AS sides", "'r' AS role", "0 AS cut", "1 AS part")
    plain = sorted(map(str, preferences.format_pairs(turns, pairs).collect()))
    assert len(plain) == 3 and sorted(map(str, preferences.format_pairs(turns, more).collect())) == plain


def test_words_scattered_over_a_text_are_no_license(spark):
    filler = [f"cow{i}" for i in range(400)]
    short = [(label, text) for label, text in licenses.TEMPLATES if len(licenses.words_of(text)) <= 16]
    assert short
    rows, want = [], []
    for label, text in short:
        said = licenses.words_of(text)
        gap = 4 * max(8, 1 << (len(said) - 1).bit_length()) // len(said)
        apart = [w for i, x in enumerate(said) for w in [x, *filler[i * gap : i * gap + gap]]]
        rows += [(len(rows), " ".join(apart)), (len(rows) + 1, " ".join([*filler[:37], *said, *filler[:90]]))]
        want += [None, label]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(want):
        assert (label in got[i].labels.split(",") and got[i].score == 1.0) if label else got[i].labels == "", (rows[i], got[i])


def test_a_passage_of_many_documents_sends_a_bucket_its_contexts_only(spark):
    rng = random.Random(12)
    passage = words_text(rng, 45, 10**6)
    rows = [(i, f"{words_text(rng, 6, 10**6)} {passage} {words_text(rng, 6, 10**6)}") for i in range(4000)]
    base = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", (F.col("doc_id") % 8).cast("int"))
    spread = base.groupBy("unit").applyInArrow(suffix._spread(50, 16), "bucket int, unit int, keys binary, many binary, warm binary")
    reply = spread.groupBy("bucket").applyInArrow(suffix._meet(16), "unit int, bucket int, keys binary, hot binary")
    rows = base.groupBy("unit").cogroup(reply.groupBy("unit")).applyInArrow(suffix._contexts(50, 16), suffix.CONTEXTS).collect()
    sent = [(len(suffix._open(bytes(r.marks))) // 32, len(r.lengths)) for r in rows if r.marks is not None]
    assert all(places == contexts for places, contexts in sent) and any(r.others is not None for r in rows)
    inside = sum(c for _, c in sent)  # contexts that reach out of the passage differ, all others are one a unit
    assert sum(len(suffix._unpack(bytes(r.others))[0]) for r in rows if r.others is not None) >= 3900 and inside < 4 * 4000
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(base.select("doc_id", "text")).collect()}
    assert got[0] == 0 and all(len(passage) <= got[i] <= len(passage) + 30 for i in range(1, 4000))


def plain_pfair(own, slots):
    """Earliest deadline first over all slots in one go."""
    total, pending, coming, out = sum(own), [], {0: [(i, 0) for i in range(len(own))]}, []
    for t in range(slots):
        for i, k in coming.pop(t, []):
            heapq.heappush(pending, (-(-(k + 1) * total // own[i]), i, k))
            coming.setdefault(max(t + 1, (k + 1) * total // own[i]), []).append((i, k + 1))
        out.append(heapq.heappop(pending)[1:])
    return out


@pytest.mark.parametrize("sources", [3, 31, 32, 400, 22])
def test_periods_apart_give_the_one_schedule(spark, sources):
    rng = random.Random(sources)
    w = {3: [1] * 3, 31: [rng.randint(1, 7) for _ in range(31)], 22: [1000, 500] + [1] * 20}.get(sources) or [0.02 + rng.random() ** 3 for _ in range(sources)]
    weights = {f"s{i:03}": float(x) for i, x in enumerate(w)}
    counts = spark.createDataFrame([(s, 1) for s in weights], "source string, n long")
    weighted = mixing.target_weights(counts, weights, 0.7)
    rows = sorted(weighted.collect(), key=lambda r: r.i)
    own, total = [r.own for r in rows], rows[0].total
    assert [r.source for r in rows] == list(weights) and all(abs(n / total - x / sum(w)) < 1e-8 for n, x in zip(own, w))
    period = mixing.period_of(max(total // n for n in own), len(own), 1000)
    got = sorted((r.slot, r.i, r.block) for r in mixing.schedule(weighted, 49_999, period).collect())
    assert [s for s, _, _ in got] == list(range(len(got))) and len(got) >= 50_000
    assert [(i, k) for _, i, k in got] == plain_pfair(own, len(got))
    done = np.zeros(len(own))
    for slot, i, k in got:
        assert k * total // own[i] <= slot < -(-(k + 1) * total // own[i])
        done[i] += 1
        assert slot % 7 or np.abs(done - np.array(own) * (slot + 1) / total).max() < 1


def test_the_least_weight_has_a_bounded_window(spark):
    n = spark.createDataFrame([("big", 10**12), ("other", 10**6), *[(f"s{k}", 1) for k in range(8)]], "source string, n long")
    rows = mixing.target_weights(n, {"big": 1.0, "other": 1e-3, "s0": 1e-15}, 0.7).collect()
    assert all(r.total // r.own <= mixing.LONGEST * 1.001 for r in rows) and len({r.own for r in rows if r.source[0] == "s"}) == 1


def test_mixed_order_is_kept_by_files(spark, docs, tmp_path):
    out = mixing.in_mixed_order(docs)
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    read = [r.doc_id for r in again.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    where = {r.doc_id: r.position for r in mixing.mix(docs).orderBy(F.desc("position")).collect()}
    assert len(read) == docs.count() and [where[i] for i in read if i is not None] == sorted(where[i] for i in read if i is not None)


def test_secrets(spark, docs):
    rng = random.Random(9)
    blob = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, " ".join(["the rain in spain falls mainly on the plain and thenerationingstheresandthere", blob(48, b64) if i % 4 == 0 else "word"])) for i in range(80)]
    rows += [
        (100, 'é password = "abcdef" PASSWD:x secret=token=abcdefg'), (101, "AKIA" + "A1" * 8 + " AKIAB"), (102, "0123456789abcdef" * 2 + "g deadbeef"), (103, None), (104, ""),
        (105, "api_key: 'zzzzzz' apikey=12345"), (106, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (0, rows[0][1]),
        (107, "plain words, " * 40_000 + "token: abcdef " + "0123456789abcdef" * 2000),
    ]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        own = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert {x for x in own.split(",") if x} <= set(r.spans.split(","))
        if r.doc_id is not None and r.doc_id < 80:
            assert r.n_random == (r.doc_id % 4 == 0), (r.doc_id, text)
    assert secrets.scan_secrets(docs).count() == docs.count()


def test_licenses(spark, docs):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    mit = next(text for label, text in licenses.TEMPLATES if label == "mit")
    filler = " ".join(f"word{k}" for k in range(90))
    rows = [(1, "Under the MIT license! under-the mit license"), (2, f"{filler}\n{gpl} {filler}"), (3, mit), (4, " ".join(mit.split()[:9])), (5, "Apache License, Version 2; CC BY-NC 4.0"), (6, None), (7, ""), (8, filler), (2, "cc by nc"), (9, f"{filler} " * 300 + gpl)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3)))
    assert by[1] == [(2, 0, 4, "mit", "mit", 1.0)] and by[3] == [(0, None, None, "", "mit", 1.0)] and by[4] == [(0, None, None, "", "", 0.0)]
    assert sorted(by[2], key=str) == [(0, None, None, "", "gpl", 1.0), (1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)] and by[9] == [(0, None, None, "", "gpl", 1.0)]
    assert by[5] == [(2, 0, 4, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0)] and by[6] == by[7] == [(0, None, None, "", "", 0.0)] and by[8][0][4] == ""
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert {(r.labels, r.score) for r in licenses.scan_licenses(docs, phrases=[], templates=[("none", "!!")]).collect()} == {("", 0.0)}


@pytest.mark.parametrize("broadcast_words", [100_000, 0])
def test_templates_of_any_length_are_found_at_any_offset(spark, monkeypatch, broadcast_words):
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", broadcast_words)
    rng = random.Random(13)
    sizes = (7, 31, 32, 33, 40, 64, 100, 400)
    templates = [(f"l{n}", words_text(rng, n, 4 * n).replace("w", f"t{n}x")) for n in sizes]
    texts, whole = [], {}
    for label, text in templates:
        for before in [*range(0, 70), *range(70, 900, 83)]:
            whole[len(texts)] = label
            texts.append(f"{words_text(rng, before)} {text} {words_text(rng, rng.randrange(90))}")
        for _ in range(20):  # with some of its words gone or changed, around the threshold
            w = [x if rng.random() < rng.choice([0.95, 0.85, 0.75]) else "changed" for x in text.split()]
            texts.append(f"{words_text(rng, rng.randrange(90))} {' '.join(w)}")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases=[], templates=templates).collect()}
    assert all(got[i] == (label, 1.0) for i, label in whole.items())
    for i, text in enumerate(texts):  # every block of every class by hand; nothing that is found lies outside all windows
        w, found, best = text.split(), set(), 0.0
        for label, t in templates:
            need, half = set(t.split()), max(licenses.LEAST, 1 << (len(t.split()) - 1).bit_length())
            for start in range(0, max(1, -(-(len(w) - 2 * half) // half) * half + 1), half):
                share = len(need & set(w[start : start + 2 * half])) / len(need)
                if share >= 0.8:
                    found.add(label)
                    best = max(best, share)
        assert got[i] == (",".join(sorted(found)), best)


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    rng = random.Random(10)
    pieces = ["it's", "don't", "'s", "'ll", "'", "  ", "\n", "\n\n ", "\t", "B1", "12", "!?", "é", "²", "<|endoftext|>", "日本", " ", "'re", "\r\n", "word", " word"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(300)] + [(500, None), (501, ""), (502, "ab " * 9000), (3, "again"), (None, "no id")]
    library = Tokenizer.from_file(tokenizer_path())
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = tokens.token_records(df, tokenizer_path()).orderBy("start").collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = encode(t)
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_damaged_record_is_found(spark):
    index = tokens.write_records(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), tokenizer_path(), [F.col("doc_id")])
    path = index.first()["file"].removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(24)
        f.write(b"\xff")
    with pytest.raises(Exception, match="damaged record"):
        tokens.read_records(index).collect()


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer here"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello there"), (2, 2, "user", "less"), (2, 3, "assistant", "no"),
        (1, 0, "user", "hi"), (3, 0, None, None), (None, 0, "user", "x"), (4, None, "user", "x"),
    ]
    turns = preferences.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pairs = spark.createDataFrame([(1, 2), (1, 99)], "chosen long, rejected long")
    got = sorted((r.part, r.turn, r.role, r.said, r.loss) for r in preferences.format_pairs(turns, pairs.limit(1)).collect())
    assert got == [
        ("chosen", 2, "user", "<|user|>\nmore<|end|>\n", False), ("chosen", 3, "assistant", "<|assistant|>\nlong answer here<|end|>\n", True),
        ("prompt", 0, "user", "<|user|>\nhi<|end|>\n", False), ("prompt", 1, "assistant", "<|assistant|>\nhello there<|end|>\n", False),
        ("rejected", 2, "user", "<|user|>\nless<|end|>\n", False), ("rejected", 3, "assistant", "<|assistant|>\nno<|end|>\n", True),
    ]
    assert turns.where("conv = 3").first().said == "<|user|>\n<|end|>\n"
    # conversation 3 says nothing as an assistant; 1 and 2 open alike; a listed pair counts once
    assert [tuple(r) for r in preferences.preference_pairs(turns).collect()] == [(1, 2, None, None, None, None)]
    twice = pairs.limit(1)
    assert preferences.format_pairs(turns, twice.union(twice)).count() == len(got)


def plain_preferences(rows):
    """Rendered rows of all pairs, by hand; one row for each conversation and turn."""
    said = {(c, t): (r, f"<|{r}|>\n{x}<|end|>\n") for c, t, r, x in rows}
    talks = {c: {t: said[c, t] for k, t in said if k == c} for c, _ in said}
    rings = {}
    for c, talk in talks.items():
        if any(r == "assistant" for r, _ in talk.values()):
            opening = hashlib.md5(talk[min(talk)][1].encode()).hexdigest()
            rings.setdefault(opening[0], []).append((opening, c))
    answer = lambda c: sum(len(x) - len("<|assistant|>\n<|end|>\n") for r, x in talks[c].values() if r == "assistant")
    last = lambda c: max(t for t, (r, _) in talks[c].items() if r == "assistant")
    out = set()
    for ring in map(sorted, rings.values()):
        for (same, a), (other, b) in zip(ring, ring[1:] + ring[:1], strict=True):
            if a == b:
                continue
            if same == other:
                a, b = (a, b) if (answer(a), -a) > (answer(b), -b) else (b, a)
                left, right = talks[a], talks[b]
            else:
                left = {t: x for t, x in talks[a].items() if t <= last(a)}
                right = left | {last(a): talks[b][last(b)]}
            cut = min((t for t in {*left, *right} if left.get(t) != right.get(t)), default=1 << 60)
            out |= {(a, b, "prompt", t, *x, False) for t, x in left.items() if t < cut}
            for part, side in (("chosen", left), ("rejected", right)):
                out |= {(a, b, part, t, *x, x[0] == "assistant") for t, x in side.items() if t >= cut}
    return out


@pytest.mark.parametrize("rows_a_range", [3, 5000])
def test_preferences_share_what_was_said_before(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(preferences, "FAMILY_ROWS", rows_a_range)
    rng = random.Random(12)
    rows = []
    for c in range(120):
        opening = f"opening {c // 3 if c % 4 else 0}" if c % 2 else f"own {c}"
        turns = [("user", opening)] + [(rng.choice(["user", "assistant"]), words_text(rng, rng.randrange(3), 5)) for _ in range(rng.randrange(6))]
        rows += [(c, t * 2, *x) for t, x in enumerate(turns)]
    rows += [(500, t, *x) for t, x in enumerate([("user", "own 0"), ("assistant", "x " * 50_000)] * 40)]
    turns = preferences.turns_of(spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string").repartition(5))
    got = [tuple(r) for r in preferences.format_pairs(turns, preferences.preference_pairs(turns)).collect()]
    want = plain_preferences(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(x[2] == "prompt" for x in want) > 100


def test_quality_on_held_out(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = words_text(rng, rng.randrange(5, 60)) + "."
        if not good:
            text = rng.choice([text.upper() + "!!", " ".join(w + "$$$" for w in text.split()), " ".join(w for w in text.split() for _ in range(5))])
        rows.append((i, text, None if i % 9 else "x", int(good)))
        labels.append((i, int(good)))
    rows += [(5000, None, None, 0), (5001, "", None, 1), (5002, "word " * 40_000, None, 1), (3, rows[3][1], None, 1), (None, "abc", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    lab = spark.createDataFrame([*labels, (None, 1), (4, None), (7, 5)], "doc_id long, quality int")
    got = quality.score_quality(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.97
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.score_quality(df, lab.where("false")).collect()} == {0.5}


@pytest.mark.parametrize(
    "run",
    [
        lambda d: minhash.near_duplicates(d), lambda d: suffix.remove_repeats(d), lambda d: mixing.mix(d), lambda d: mixing.in_mixed_order(d), lambda d: secrets.scan_secrets(d),
        lambda d: licenses.scan_licenses(d), lambda d: tokens.token_records(d, tokenizer_path()),
        lambda d: decontam.contamination(d, d.select(F.col("doc_id").cast("string").alias("item_id"), "text")),
        lambda d: quality.score_quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
        lambda d: vectors.near_vectors(d.select(F.col("doc_id").alias("vec_id"), F.array().cast("array<float>").alias("embedding"))),
        lambda d: preferences.format_pairs(t := preferences.turns_of(d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.col("source").alias("role"), "text")), preferences.preference_pairs(t)),
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_other_operators_take_awkward_rows(docs):
    got = {(r.doc_id, r.n_bytes): r for r in suffix.remove_repeats(docs).collect()}
    for (i, text), want in plain_repeats([r for r in awkward_rows() if len(r[1] or "") < 50_000]).items():
        if i is not None and i != 3:
            r = got[(i, len((text or "").encode()))]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
    assert tokens.token_records(docs, tokenizer_path()).count() == docs.count()


def test_siblings_meet_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(preferences, "FAMILY_ROWS", 7)
    rows = [(i, 0, "user", f"opening {i // 2}") for i in range(800)] + [(i, 1, "assistant", "x" * (i % 5)) for i in range(800)]
    turns = preferences.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(sorted(r)) for r in preferences.preference_pairs(turns).where("at is null").select("chosen", "rejected").collect()]
    assert {(2 * k, 2 * k + 1) for k in range(400)} == set(got) and len(got) == 400


@pytest.mark.parametrize("given", [True, False])
def test_mix_of_many_sources_keeps_to_the_weights(spark, given):
    n = {f"s{k:03}": 3000 if k == 0 else 2 + k % 7 for k in range(450)}
    df = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, c in n.items() for _ in range(c))], "doc_id long, source string")
    weights = {s: 0.5 if s == "s000" else 0.4 / 300 if k % 3 else 0.1 / 149 for k, s in enumerate(n)} if given else None
    got = mixing.mix(df, weights, block_docs=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got))) and sorted(r.doc_id for r in got) == list(range(sum(n.values())))
    assert [r.slot for r in got] == sorted({r.slot for r in got})
    target = weights or {s: c**0.7 for s, c in n.items()}
    total = sum(target.values())
    for s, w in target.items():
        slots = [r.slot for r in got if r.source == s]
        assert len(slots) == n[s]
        for k, slot in enumerate(slots):  # just before and just after its block
            assert abs(slot * w / total - k) < 1 + 1e-6 and abs((slot + 1) * w / total - (k + 1)) < 1 + 1e-6, (s, k, slot)
    if given:
        done = sum(r.slot < 1000 for r in got if r.source == "s000")
        assert abs(done - 500) < 1


@pytest.mark.parametrize("length", [20, 24, 32])
def test_short_keys_among_a_thousand_candidates(spark, length):
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz"
    key = lambda: "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(length))
    names = ["".join(rng.choices(letters, [8, 1, 3, 4, 12, 2, 2, 6, 7, 0.2, 0.8, 4, 2.4, 6.7, 7.5, 2, 0.1, 6, 6.3, 9, 2.8, 1, 2.4, 0.2, 2, 0.1], k=rng.randrange(3, 9))) for _ in range(500)]
    join = [lambda w: "/".join(w), lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "/".join([*w[:-1], w[-1].title(), "2024-01-02"])]
    rows = []
    for i in range(8000):
        name = rng.choice(join)(rng.choices(names, k=8))[: max(20, rng.randrange(length, length + 4))]
        rows.append((i, f"The {' '.join(rng.choices(names, k=20))} {name} {key() if i % 1000 == 7 else 'In 2024'}."))
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.n_random}
    planted = {i for i in range(8000) if i % 1000 == 7}
    assert len(found & planted) >= 7 and len(found - planted) <= 1, (len(found & planted), [rows[i][1] for i in sorted(found - planted)][:5])


def plain_boosting(x, y, rounds, pairs):
    """The same model from rows and explicit trees: ``(trees, start)``; a tree is a function of a row."""
    rate, ridge = quality.RATE, quality.RIDGE
    share = (y.sum() + 1) / (len(y) + 2)
    total = [math.log(share / (1 - share))] * len(y)
    start, trees = total[0], []
    cuts = lambda n: [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    fine, coarse = cuts(quality.BINS), cuts(quality.PAIR_BINS)
    slopes = lambda: [(t - 1 / (1 + math.exp(-s)), 1 / (1 + math.exp(-s)) * (1 - 1 / (1 + math.exp(-s)))) for t, s in zip(y, total, strict=True)]
    gain = lambda rows, gh: sum(gh[r][0] for r in rows) ** 2 / (sum(gh[r][1] for r in rows) + ridge)
    value = lambda rows, gh: sum(gh[r][0] for r in rows) / (sum(gh[r][1] for r in rows) + ridge)

    def best(rows, j, edges, gh):
        """(gain, edge) of the best cut of some rows by one feature."""
        found = (0.0, None)
        for e in edges:
            left, right = [r for r in rows if x[r, j] < e], [r for r in rows if x[r, j] >= e]
            more = gain(left, gh) + gain(right, gh) - gain(rows, gh)
            if more > found[0] + 1e-12:
                found = (more, e)
        return found

    def grow(tree):
        trees.append(tree)
        for r in range(len(y)):
            total[r] += rate * tree(x[r])

    every = range(len(y))
    for _ in range(rounds):
        for j in range(x.shape[1]):
            gh, parts = slopes(), [(-math.inf, math.inf)]
            for _ in range(2):
                inside = lambda p, j=j: [r for r in every if p[0] <= x[r, j] < p[1]]
                options = [(*best(inside(p), j, [e for e in fine[j] if p[0] < e < p[1]], gh), p) for p in parts]
                more, e, p = max(options, key=lambda o: o[0])
                if e is None or more <= 1e-9:
                    break
                parts = [q for q in parts if q != p] + [(p[0], e), (e, p[1])]
            leaves = [(p, value(inside(p), gh)) for p in parts]
            grow(lambda row, j=j, leaves=leaves: next(v for p, v in leaves if p[0] <= row[j] < p[1]))
    for _ in range(rounds // 4):
        for i, j in pairs:
            gh, top, chosen = slopes(), 0.0, None
            for e in coarse[i]:
                sides = [[r for r in every if x[r, i] < e], [r for r in every if x[r, i] >= e]]
                seconds = [best(rows, j, coarse[j], gh) for rows in sides]
                got = sum(gain(rows, gh) + s[0] for rows, s in zip(sides, seconds, strict=True))
                if got > top + 1e-12:
                    leaves = [[(rows, None)] if s[1] is None else [([r for r in rows if x[r, j] < s[1]], s[1]), ([r for r in rows if x[r, j] >= s[1]], s[1])] for rows, s in zip(sides, seconds, strict=True)]
                    top, chosen = got, (e, [[(value(rows, gh), cut) for rows, cut in side] for side in leaves])

            def tree(row, i=i, j=j, chosen=chosen):
                side = chosen[1][int(row[i] >= chosen[0])]
                return side[int(len(side) > 1 and row[j] >= side[0][1])][0]

            grow(tree)
    return trees, start


def test_additive_model_is_a_sum_of_its_trees(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 8)
    monkeypatch.setattr(quality, "PAIRS", 2)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(160, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(160) < 0.1)).astype(int)
    model = quality.Additive().fit(x, y)
    trees, start = plain_boosting(x, y, 8, model.pairs)
    assert len(trees) == 8 * 3 + 2 * 2 and len(model.pairs) == 2
    new = rng.normal(size=(50, 3))
    want = [1 / (1 + math.exp(-(start + sum(quality.RATE * t(row) for t in trees)))) for row in new]
    assert model.score(new) == pytest.approx(want, abs=1e-9)
