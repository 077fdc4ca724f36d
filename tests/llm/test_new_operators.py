"""Prefix trie, spelling variants and language scores against plain versions, with the awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, spelling, trie
from tidemark.llm._elias_fano import EliasFano

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, depth string, node int, words string"
DOCS = "doc_id long, text string, word string, n string, unit int"


def plain_trie(rows, family=20, choices=4):
    own = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % choices
        whole[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:]
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(out[k][5] for k in children[p]) or 1
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out[p] = (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves,
            (len(m) - 1) * words + sum(out[k][6] for k in children[p]), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def turns_like(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f"]), "x", 1, "y"))
    rows += [(7, None, "system", "first", "x", 1, "y"), (8, 3, None, None, None, None, None), (8, 3, "", "", None, None, None), (8, 3, None, "z z", None, None, None)]
    rows += [(None, 0, "user", "lost", None, None, None), (-21, 0, "user", "a b", None, None, None), (500, 0, "user", "long " * 3000, None, None, None)]
    rows += [(900 + i, t, "user", "the same", None, None, None) for i in range(40) for t in range(5)] + [(77, t, "user", f"{t}", None, None, None) for t in range(300)]
    return rows


@pytest.mark.parametrize("ranges", [20_000, 40, 3])
def test_trie_equals_plain_prefixes_however_it_is_cut(spark, ranges):
    rows = turns_like(1, 120)
    seqs = trie.rebuilt(trie.sequences(spark.createDataFrame(rows, TURNS).repartition(5)))
    got = sorted((tuple(r) for r in trie.prefix_trie(seqs, ranges).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(1, 0, "user", "a", None, None, None)], [(5, 0, "user", "a", None, None, None), (6, 0, "user", "a", None, None, None)]):
        got = sorted((tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str)
        assert got == plain_trie(rows)


def test_edge_nodes_are_few_and_carry_the_rest_as_sums(spark):
    rows = turns_like(2, 300)
    seqs = trie.sequences(spark.createDataFrame(rows, TURNS))
    found = trie.distinct_sequences(seqs).collect()
    found.sort(key=lambda r: r.key)
    forest = trie._Forest([bytes(r.key) for r in found], *([r[c] for r in found] for c in ("words", "n", "conv", "ends")))
    shared = trie.neighbour_prefixes([bytes(r.key) for r in found])
    for i in np.argsort(-shared, kind="stable").tolist():
        forest.merge(i, i + 1, int(shared[i]))
    nodes = forest.finish()
    edge = [r for r in nodes if r[11]]
    assert len(edge) <= len(found[0].key) // 16 + len(found[-1].key) // 16 + 1 < len(nodes)
    assert next(r[4] for r in edge if r[1] == 0) == sum(r.n for r in found)


def plain_words(rows, slip=31):
    n = collections.Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def spelled(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 12))) for _ in range(12)]
    text = []
    for s in stems:
        text += [s] * rng.choice([300, 40, 3])
        for _ in range(30):
            k, c = rng.randrange(len(s) + 1), rng.choice("abÀÿz")
            text += [rng.choice([s[:k] + c + s[k:], s[:k] + c + s[k + 1 :], s[:k] + s[k + 1 :]])] * rng.choice([1, 2, 4])
    text += ["chainaaa"] * 400 + ["chainaab"] * 25 + ["chainbab"] * 2
    text = [w.upper() if rng.random() < 0.2 else w for w in text]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::25]) + " short x-ray, Straße_naïve", "w", "9", 1) for i in range(25)]
    return rows + [rows[0], (None, rows[1][1], None, None, None), (98, None, None, None, None), (99, "", None, None, None), (97, "ÀÉÎ" * 9000 + " aaaaaaa" * 3000, None, None, None)]


@pytest.mark.parametrize("tile", [1024, 4])
def test_spelling_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)  # small tiles deal every block to parts
    rows = spelled(3)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_of_nothing_and_roots_of_long_chains(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(18)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(chain).collect()} == {(f"w{i}", "w18") for i in range(18)}


def test_a_large_block_is_dealt_to_tiles(spark):
    words = spark.range(5000).select(F.concat(F.lit("abc"), F.lpad(F.conv(F.col("id").cast("string"), 10, 26), 3, "0"), F.lit("xyz")).alias("word"), F.lit(2).cast("long").alias("n"))
    tiles = spelling.blocks(words).groupBy("short", "key", "p", "q").count()
    assert tiles.agg(F.max("count")).first()[0] < 3 * spelling.TILE
    assert spelling.near_words(words).agg(F.sum("n_near")).first()[0] > 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 5, 5, 9, 10**6], list(range(200)), [2**63 + 5, 2**63 + 6, 2**64 - 1]])
def test_elias_fano_of_small_sequences(values):
    check_elias_fano(np.array(values, np.uint64))


def test_elias_fano_of_random_sequences():
    rng = np.random.default_rng(4)
    for size, top in ((1000, 1200), (5000, 2**40), (70_000, 2**20), (70_001, 2**62)):
        check_elias_fano(np.sort(rng.integers(0, top, size, dtype=np.uint64)))


def check_elias_fano(values):
    ef = EliasFano(EliasFano.arrays(values))
    assert ef.access(np.arange(len(values))).tolist() == values.tolist()
    rng = np.random.default_rng(1)
    x = np.concatenate([values[:500], values[:500] + np.uint64(1), rng.integers(0, min(int(values.max(initial=7)), 2**64 - 3) + 2, 300, dtype=np.uint64)])
    ends = np.sort(rng.integers(0, len(values) + 1, (len(x), 2)), axis=1)
    at, found = ef.find(x, ends[:, 0], ends[:, 1])
    for v, (lo, hi), i, f in zip(x, ends, at, found, strict=True):
        want = lo + int(np.searchsorted(values[lo:hi], v))
        assert f == (want < hi and values[want] == v) and (not f or i == want)
    size = sum(a.nbytes for k, a in EliasFano.arrays(values).items() if k in ("low", "high"))
    assert size <= len(values) * (2 + max(0, math.log2((int(values.max(initial=0)) + 1) / max(len(values), 1)))) / 8 + 40


def plain_scores(rows, alpha, mu):
    code = lambda x: int(np.rint(np.log10(x) * lm.STEPS))
    three, two, one, texts = collections.Counter(), collections.Counter(), collections.Counter(), []
    for i, text, *_ in rows:
        w = [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]
        out = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        texts.append((i, out, w))
        if not out:
            s = [0, 0, *w]
            three.update(zip(s, s[1:], s[2:]))
            two.update(zip(s[1:], s[2:]))
            one.update(w)
    total, kinds, scores = sum(one.values()), len(one), []
    for i, out, w in texts:
        s, score = [0, 0, *w], 0
        for a, b, c in zip(s, s[1:], s[2:]):
            pair, last = (one[None], one[None]) if b == 0 else (two[a, b], one[b])
            score += code(three[a, b, c] + alpha * (two[b, c] + mu * (one[c] + 1) / (total + kinds + 1))) - code(pair + alpha * (last + mu))
        base = sum(math.log10((one[x] + 1) / (total + kinds + 1)) for x in w)
        scores.append((i, out, len(w), sum(one[x] > 0 for x in w), total, round(base, 6), score / lm.STEPS))
    return sorted(scores, key=str)


def texts_like(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60))), "w", "9", 1) for i in range(150)]
    rows += [(i, "the one text  that\tRecurs", None, None, None) for i in range(200, 260)]
    return rows + [rows[3], rows[3], (None, "no id here", None, None, None), (300, None, None, None, None), (301, "", None, None, None), (302, "é x " * 8000, None, None, None)]


@pytest.mark.parametrize("unit, shard", [(2_000_000, 3_000_000), (500, 700)])
def test_language_scores_equal_plain_counts(spark, unit, shard):
    rows = texts_like(5)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = lm.language_scores(docs, unit_tokens=unit, shard_tokens=shard).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got), key=str)
    assert got == plain_scores(rows, lm.ALPHA, lm.MU)


def test_probabilities_add_up_to_one():
    rng = random.Random(6)
    s = [rng.choice("abcd") for _ in range(400)]
    three, two, one = collections.Counter(zip(s, s[1:], s[2:])), collections.Counter(zip(s, s[1:])), collections.Counter(s)
    alpha, mu, total = lm.ALPHA, lm.MU, len(s)
    for a, b in set(zip(s, s[1:-1])):
        pair, last = sum(three[a, b, c] for c in "abcd"), sum(two[b, c] for c in "abcd")
        known = sum((three[a, b, c] + alpha * (two[b, c] + mu * (one[c] + 1) / (total + 5))) / (pair + alpha * (last + mu)) for c in "abcd")
        unknown = alpha * mu / (total + 5) / (pair + alpha * (last + mu))
        assert abs(known + unknown - 1) < 1e-9


def test_language_scores_of_nothing_and_of_held_out_texts_only(spark):
    assert lm.language_scores(spark.createDataFrame([], DOCS)).count() == 0
    i = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    rows = [(i, "all is held out", None, None, None)]
    (got,) = lm.language_scores(spark.createDataFrame(rows, DOCS)).collect()
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0.0) and got.score == plain_scores(rows, lm.ALPHA, lm.MU)[0][-1]


def test_a_frequent_word_is_dealt_to_several_shards():
    rng = np.random.default_rng(7)
    word, before = np.full(5000, 77, np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    assert len(np.unique(lm._shard_of(word, before, np.array([77], np.uint64), 16))) == 16
    assert len(np.unique(lm._shard_of(word, before, np.array([], np.uint64), 16))) == 1
