"""Prefix trie of conversations: what they share from their first turn on, with members, children, leaves and tokens saved.

A conversation becomes the sequence of its turns' digests. Equal sequences collapse, the distinct ones are sorted over ranges,
and each range builds the forest of its sequences: neighbours' longest common prefixes are edges, taken in descending depth by
union-find; a merge of components creates a branching node at its depth, and the chain below each component is written out on
the way up. Prefixes of a range's first or last sequence may go on in other ranges. These, the contracted forest of a few
nodes a range, carry what lies below them in their range as sums; they are merged by digest, and one task over them adds the
sums up. Nothing else meets across ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise
from ._text import frugal

SOLID_WORD = "[^\\x20\\x09-\\x0D]+"
FAMILY, CHOICES = 20, 4
#: Turns of distinct sequences in a range, about.
RANGE_TURNS = 20_000
MARK = 16
NOTHING = hashlib.sha256(b"").hexdigest()

NODES = """conv_id long, depth long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, words long,
  ends_sha256 string, node binary, edge boolean"""


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, marks, words)``: digests of a conversation's turns in the order of turn (null first; ties by digest) and the
    number of words of each text. Null role or text counts as empty; rows without a conversation go."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.struct(
            F.col(turn_col).isNotNull().alias("known"),
            F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("mark"),
            F.regexp_count(text, F.lit(SOLID_WORD)).alias("words"),
        ).alias("t"),
    )
    own = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return own.select("conv", F.col("t.mark").alias("marks"), F.col("t.words").alias("words"))


def rebuilt(seqs: DataFrame, family: int = FAMILY, choices: int = CHOICES) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % family; h is the crc32 of c's digits % choices."""
    heads = seqs.where(F.col("conv") % family == 0)
    heads = heads.select(F.col("conv").alias("base"), F.slice("marks", 1, choices - 1).alias("head_marks"), F.slice("words", 1, choices - 1).alias("head_words"))
    own = seqs.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % choices).cast("int"))
    joined = own.join(heads, "base", "left")
    part = lambda name: F.concat(
        F.coalesce(F.slice(f"head_{name}", F.lit(1), F.col("h")), F.slice(name, 1, 0)), F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))
    )
    return joined.select("conv", part("marks").alias("marks"), part("words").alias("words"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids sorted by sequence: how many share it, the first, and the digest of all, never holding more than a batch."""
    now, n, first, digest = None, 0, None, None
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, lo = [], 0
        while lo < len(keys):
            if keys[lo] != now:
                if n:
                    out.append((now, n, first, digest.hexdigest()))
                now, n, first, digest = keys[lo], 0, ids[lo], hashlib.sha256()
            hi = lo
            while hi < len(keys) and keys[hi] == now:
                hi += 1
            digest.update((("," if n else "") + ",".join(map(str, ids[lo:hi]))).encode())
            n += hi - lo
            lo = hi
        if out:
            yield _rows(out)
    if n:
        yield _rows([(now, n, first, digest.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    k, n, c, s = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(s)], names=["seq", "n", "conv", "ends"])


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """``(key, words, n, conv, ends)``: one row per distinct sequence, its members' number, smallest id and digest."""
    keyed = materialise(seqs.select("conv", F.unhex(F.array_join("marks", "")).alias("key"), "words"), "sequences")
    ids = keyed.select(F.unhex(F.md5("key")).alias("seq"), "conv").repartition("seq").sortWithinPartitions("seq", "conv")
    found = ids.mapInArrow(frugal(_ends), "seq binary, n long, conv long, ends string")
    return keyed.join(found.drop("seq"), "conv")


class _Forest:
    """Union-find over sorted sequences; a component is a subtree whose top node may still get children."""

    def __init__(self, keys: list[bytes], words: list[list[int]], n: list[int], conv: list[int], ends: list[str]):
        self.keys, self.words, m = keys, words, len(keys)
        self.up = list(range(m))
        self.depth = [len(k) // MARK for k in keys]
        self.n, self.conv, self.ends = list(n), list(conv), list(ends)
        self.children, self.leaves, self.saved = [0] * m, [0] * m, [0] * m
        self.edge = [False] * m
        self.edge[0] = self.edge[-1] = True
        self.below: list[list[int]] = [[] for _ in range(m)]  # rows of the top node's children
        self.rows: list[list] = []
        self.parent_row: list[int] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def close(self, c: int) -> None:
        """Write the top node of a component; it becomes the only thing below the next depth."""
        d, key = self.depth[c], self.keys[c]
        word = self.words[c][d - 1] if d else 0
        edge, leaves = self.edge[c], self.leaves[c]
        if not edge:
            leaves = leaves if self.children[c] else 1
            self.saved[c] += (self.n[c] - 1) * word
        row = len(self.rows)
        node = hashlib.md5(key[: d * MARK]).digest() if edge else None
        above = hashlib.md5(key[: d * MARK - MARK]).digest() if edge and d else None
        self.rows.append([self.conv[c], d, None, above, self.n[c], self.children[c], leaves, self.saved[c], word, self.ends[c], node, edge])
        self.parent_row.append(-1)
        for b in self.below[c]:
            self.parent_row[b] = row
        self.below[c], self.depth[c], self.ends[c] = [row], d - 1, None
        if edge:  # what an edge node holds is added up later
            self.children[c], self.leaves[c], self.saved[c] = 0, 0, 0
        else:
            self.children[c], self.leaves[c] = 1, leaves

    def climb(self, c: int, depth: int) -> None:
        while self.depth[c] > depth:
            self.close(c)

    def merge(self, i: int, j: int, depth: int) -> None:
        a, b = self.find(i), self.find(j)
        self.climb(a, depth)
        self.climb(b, depth)
        self.up[b] = a
        self.n[a] += self.n[b]
        self.conv[a] = min(self.conv[a], self.conv[b])
        self.ends[a] = self.ends[a] or self.ends[b]
        self.children[a] += self.children[b]
        self.leaves[a] += self.leaves[b]
        self.saved[a] += self.saved[b]
        self.edge[a] |= self.edge[b]
        self.below[a] += self.below[b]

    def finish(self) -> list[list]:
        self.climb(self.find(0), -1)
        for row, p in zip(self.rows, self.parent_row, strict=True):
            if p >= 0 and not row[11]:
                above = self.rows[p]
                row[2], row[3] = (None, above[10]) if above[11] else (above[0], None)
        return self.rows


def neighbour_prefixes(keys: list[bytes]) -> np.ndarray:
    """How many turns each sequence shares with the next, depth by depth over all that still agree."""
    turns = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    length = np.array([len(k) // MARK for k in keys], np.int64)
    start = np.cumsum(length) - length
    shared = np.zeros(len(keys) - 1, np.int64)
    live, d = np.arange(len(keys) - 1), 0
    while len(live):
        live = live[np.minimum(length[live], length[live + 1]) > d]
        live = live[(turns[start[live] + d] == turns[start[live + 1] + d]).all(axis=1)]
        d += 1
        shared[live] = d
    return shared


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    keys, *rest = (table[name].to_pylist() for name in ("key", "words", "n", "conv", "ends"))
    forest = _Forest(keys, *rest)
    shared = neighbour_prefixes(keys)
    for i in np.argsort(-shared, kind="stable").tolist():
        forest.merge(i, i + 1, int(shared[i]))
    yield from _node_batches(forest.finish())


def _node_batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.bool_()]
    names = [c.split()[0] for c in NODES.replace("\n", " ").split(",")]
    for lo in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes, one row each: children, leaves and savings of the edge nodes below join those found inside the ranges."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table).to_pylist()
    rows.sort(key=lambda r: -r["depth"])
    at = {r["node"]: r for r in rows}
    for r in rows:
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        if r["parent"] is not None:
            above = at[r["parent"]]
            r["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    names = [c.split()[0] for c in NODES.replace("\n", " ").split(",")]
    yield from _node_batches([[r[c] for c in names] for r in rows])


def prefix_trie(seqs: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences ``(conv, marks, words)``, the empty one (the root) included.

    A conversation without turns is a member of the root alone; an empty table has no nodes. Identical conversations are one
    sequence before anything is sorted; their ids are streamed through the digest in order. One conversation is held as a whole
    (16 bytes a turn), a range about ``range_turns`` turns beyond it.
    """
    distinct = materialise(distinct_sequences(seqs), "distinct")
    total = distinct.agg(F.coalesce(F.sum(F.length("key") / MARK + 1), F.lit(0)).alias("turns")).first()["turns"]
    ranges = max(1, -int(-total // range_turns))
    nodes = materialise(distinct.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(frugal(_forest), NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where("edge").groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"))
    columns = nodes.columns
    merged = merged.withColumn("edge", F.lit(True)).withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    edge = materialise(merged.coalesce(1).mapInArrow(_add_up, NODES), "edge")
    parents = edge.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = nodes.where("NOT edge").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)
    return inner.unionByName(edge).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, family: int | None = FAMILY, choices: int = CHOICES, **columns) -> DataFrame:
    """The prefix trie of conversations, rebuilt by families first unless ``family`` is None. Other columns are not read."""
    seqs = sequences(conversations, **columns)
    return prefix_trie(rebuilt(materialise(seqs, "turns"), family, choices) if family else seqs)
