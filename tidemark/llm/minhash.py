"""Near-duplicate documents: a chosen-path set similarity join over minwise tokens, links confirmed on full sets.

1. One scan shingles every whole text into a set of 64-bit shingle hashes and draws ``COORDINATES`` minwise tokens.
2. Equal sets collapse to their smallest doc_id, so copies never meet each other.
3. ``TREES`` independent trees branch the rest by one minwise token a level. A node of at most ``LEAF`` documents is
   compared exhaustively; a larger one branches again, at most ``DEPTH`` times. A pair of similarity s that meets in nodes of
   level k misses a tree with probability 1 - s**k: at 0.75 it misses all 24 trees with probability 0.25**24 if small nodes part
   it from others at once, and (1 - 0.75**4)**24, about 0.0001, if it always stands among many that resemble it. Inside a node,
   minwise sketches only discard pairs that agree in fewer than ``AGREE`` of 96 coordinates (over five standard deviations below
   what similarity 0.75 gives).
4. The surviving candidates form loose groups; each document's full set travels once, to its group, where similarity is
   counted exactly and unions skip pairs that are linked already. A group over ``GROUP_SHINGLES`` or ``GROUP_DOCS`` is dealt
   to random blocks of bounded size, several times; what the blocks leave apart is compared with every member, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._graph import components, join_counted
from ._shared import materialise

SHINGLE = 5
TREES, DEPTH = 24, 4
COORDINATES = TREES * DEPTH
LEAF = 32
AGREE = 50
GROUP_SHINGLES, GROUP_DOCS = 4_000_000, 4_000
BLOCK_ROUNDS = 3
SALTS = 32

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: ``(first row, distinct shingle hashes, bounds)``; hashes ascend within each text.

    The hash of a text's row in its run takes the top 12 bits while sorting, so 52 bits tell shingles apart.
    """
    for lo, hi, data, offsets in _text.slices(column):
        h, _, _, first = _text.words(data, offsets, _text.SOLID)
        counts = np.diff(first)
        n = np.maximum(counts - size + 1, np.minimum(counts, 1))
        row = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        short = counts[row] < size
        s = np.full(len(row), 0x51ED, np.uint64)
        last = first[row + 1]
        for k in range(size):
            inside = at + k < last
            s = np.where(inside, _text.mix(s * np.uint64(31) + h[np.minimum(at + k, max(len(h) - 1, 0))]), s) if len(h) else s
        s = np.where(short, s + np.uint64(1), s)
        keyed = (row.astype(np.uint64) << np.uint64(52)) | (s >> np.uint64(12))
        keyed.sort()
        if len(keyed):
            keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
        bounds = np.searchsorted(keyed >> np.uint64(52), np.arange(hi - lo + 1))
        yield lo, keyed & np.uint64((1 << 52) - 1), bounds


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_out, prints, sigs = [], [], []
        for _, s, bounds in shingle_sets(batch.column(1)):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sig = np.zeros((len(n), COORDINATES), np.int32)
            finger = np.zeros((len(n), 2), np.int64)
            if len(full):
                starts = bounds[:-1][full]
                spread = _text.mix(s)
                for k in range(COORDINATES):
                    low = np.minimum.reduceat(_text_order(spread, k), starts)
                    sig[full, k] = low.view(np.int32)
                finger[full, 0] = np.add.reduceat(spread, starts).view(np.int64)
                finger[full, 1] = np.add.reduceat(_text.mix(spread ^ np.uint64(0xABCDEF)), starts).view(np.int64)
            n_out.append(n.astype(np.int64))
            prints.append(finger)
            sigs.append(sig)
        if n_out:
            finger = np.concatenate(prints)
            flat = pa.array(np.concatenate(sigs).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_out)), pa.array(finger[:, 0].copy()), pa.array(finger[:, 1].copy()), lists],
                names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
            )


def _text_order(spread: np.ndarray, k: int) -> np.ndarray:
    """The k-th random order of shingles, as 32-bit ranks."""
    return ((spread * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32)


class Union:
    """Union-find over 0..n-1 that keeps the smallest number as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Whole runs of equal leading columns out of sorted batches; a run that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        if held:
            change[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != keys[k][0] for k in range(n_keys))
        at = np.flatnonzero(change)
        if not len(at):
            held.append(batch)
            continue
        if held or at[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, at[0])])
        if at[-1] > at[0]:
            yield pa.Table.from_batches([batch.slice(at[0], at[-1] - at[0])])
        held = [batch.slice(at[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(*keys: np.ndarray) -> np.ndarray:
    change = np.ones(len(keys[0]), bool)
    if len(change):
        change[1:] = False
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(change), len(change))


def _list_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _node_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns node, rep, sig sorted by node: a spanning forest of the pairs of each node whose sketches allow a link."""
    for table in _key_runs(batches, 1):
        node, rep = (table.column(k).to_numpy() for k in (0, 1))
        sig = _list_matrix(table.column(2), COORDINATES)
        a, b = [], []
        cuts = _bounds(node)
        two = cuts[:-1][np.diff(cuts) == 2]
        ok = (sig[two] == sig[two + 1]).sum(1) >= AGREE
        a.append(rep[two[ok]])
        b.append(rep[two[ok] + 1])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 3:
                continue
            m = sig[lo:hi]
            links = np.argwhere(np.triu((m[:, None, :] == m[None, :, :]).sum(2) >= AGREE, 1))
            forest = Union(hi - lo)
            for x, y in links:
                forest.join(int(x), int(y))
            root = np.array([forest.find(x) for x in range(hi - lo)])
            far = np.flatnonzero(root != np.arange(hi - lo))
            a.append(rep[lo + far])
            b.append(rep[lo + root[far]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _linked(sets: list[np.ndarray], num: int, den: int, left: np.ndarray | None = None) -> Union:
    """Union-find over sets: joined where ``den * |x & y| >= num * |x | y|``, each pair counted unless joined already.

    With ``left`` (a mask), only pairs with at least one set of ``left`` are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    forest = Union(n)
    flat = np.concatenate([sets[i] for i in order])
    _, ids = np.unique(flat, return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(size[order])])
    size = size[order]
    root = np.arange(n)
    flag = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    for i in range(n - 1):
        # by size, a partner of i can have at most den/num times its elements
        top = int(np.searchsorted(size, size[i] * den // num, "right"))
        js = np.arange(i + 1, top)
        js = js[root[js] != root[i]]
        if left is not None and not left[order[i]]:
            js = js[left[order[js]]]
        if not len(js):
            continue
        mine = ids[cuts[i] : cuts[i + 1]]
        flag[mine] = True
        if len(js) * 3 > top - i:
            part = flag[ids[cuts[i + 1] : cuts[top]]]
            both = np.add.reduceat(part, cuts[i + 1 : top] - cuts[i + 1], dtype=np.int64)[js - i - 1]
        else:
            both = np.array([int(flag[ids[cuts[j] : cuts[j + 1]]].sum()) for j in js])
        flag[mine] = False
        hit = js[den * both >= num * (size[i] + size[js] - both)]
        if len(hit):
            joined = np.unique(np.append(root[hit], root[i]))
            root[np.isin(root, joined)] = joined[0]
    for i in range(n):
        forest.join(int(order[i]), int(order[root[i]]))
    return forest


def _confirm(num: int, den: int, asked: bool):
    """Columns key1, key2, rep, size, set (and asked): exact links within each run of the keys, as star edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _key_runs(batches, 2):
            k1, k2, rep = (table.column(k).to_numpy() for k in range(3))
            blobs = table.column(3)
            ask = table.column(4).to_numpy(zero_copy_only=False) if asked else None
            a, b = [], []
            cuts = _bounds(k1, k2)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(blobs[int(i)].as_buffer(), np.int64) for i in range(lo, hi)]
                forest = _linked(sets, num, den, ask[lo:hi] if asked else None)
                root = np.array([forest.find(x) for x in range(hi - lo)])
                far = np.flatnonzero(root != np.arange(hi - lo))
                a.append(rep[lo + far])
                b.append(rep[lo + root[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return work


def _set_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _text.pieces(whole)):
        blobs = [s[x:y].tobytes() for _, s, bounds in shingle_sets(batch.column(2)) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["comp", "rep", "set"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row; links are ``den*|A&B| >= num*|A|B|`` on shingle sets.

    Null or blank texts have no shingles and link with nothing. Rows that repeat an id count as one vertex and each give a
    row. A null id gives a row with a null component that is kept. An empty table gives an empty result. Other columns,
    whatever their names, are not read. A text of fewer than five words is one shingle. Of a very long text all shingles count; its
    set is one row of its group.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialise(
        base.mapInArrow(_text.frugal(_signatures), "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>"), "signatures"
    )
    solid = sig.where("n_shingles > 0 and doc_id is not null")
    firsts = solid.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    keys = ["doc_id", "fp1", "fp2", "n_shingles"]
    # a set may have copies without number: its copies are dealt to SALTS tasks, each of which gets the set's root
    several = firsts.where("last > rep").drop("last")
    salted = solid.select(*keys, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    reps = firsts.drop("last").withColumnRenamed("rep", "doc_id").join(solid, keys).dropDuplicates(keys)

    candidates = materialise(_candidates(reps, firsts.count()), "candidates")
    loose = components(candidates)
    links = _confirmed(spark, base, sig, loose, num, den)
    # ids of several sets tie those sets together; copies are told their set's root afterwards and are no part of the graph
    each = F.struct(*keys[1:])
    torn = solid.groupBy("doc_id").agg(F.min(each).alias("a"), F.max(each).alias("b")).where("a != b").select("doc_id")
    ties = solid.join(torn, "doc_id").join(firsts, keys[1:]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = materialise(components(links.unionByName(ties)), "components")
    rooted = several.join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    copies = salted.join(rooted.select(*keys[1:], "rep", "root", salts), [*keys[1:], "salt"]).where("doc_id != rep")
    found = found.unionByName(copies.select(F.col("doc_id").alias("v"), "root")).distinct()
    return (
        sig.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("v", "doc_id"), "doc_id", "left")
        .select(
            F.col("doc_id").alias(id_col),
            "n_shingles",
            F.coalesce("root", "doc_id").alias("component_id"),
            (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("root", "doc_id"))).alias("kept"),
        )
    )


def _candidates(reps: DataFrame, sets: int) -> DataFrame:
    """Edges ``(a, b)`` that span, within each tree node, the documents whose sketches allow a link; ``reps`` are ``sets`` rows."""
    at = lambda level: F.expr(f"sig[tree * {DEPTH} + {level}]")
    active = reps.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select(
        "doc_id", F.xxhash64("tree", at(0)).alias("node"), *[at(k).alias(f"m{k}") for k in range(1, DEPTH)]
    )
    leaves, stars = [], None
    total = TREES * sets
    for level in range(DEPTH):
        size = active.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
        met = join_counted(active, size, "node", total)
        leaves.append(met.where(f"n <= {LEAF}").select("node", "doc_id"))
        rest = met.where(f"n > {LEAF}")
        if level + 1 < DEPTH:
            active = materialise(
                rest.select("doc_id", F.xxhash64("node", f"m{level + 1}").alias("node"), *[f"m{k}" for k in range(level + 2, DEPTH)]),
                f"level{level + 1}",
            )
            total = active.count()
        else:
            # who shares DEPTH minwise tokens in a large node is a candidate without a sketch
            stars = rest.where("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.join(reps.select("doc_id", "sig"), "doc_id").select("node", "doc_id", "sig")
    pairs = nodes.repartition("node").sortWithinPartitions("node").mapInArrow(_text.frugal(_node_edges), "a long, b long")
    return pairs.unionByName(stars).distinct()


def _confirmed(spark, base: DataFrame, sig: DataFrame, loose: DataFrame, num: int, den: int) -> DataFrame:
    sizes = loose.join(sig.groupBy(F.col("doc_id").alias("v")).agg(F.max("n_shingles").alias("n")), "v")
    total = sizes.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("members"))
    placed = materialise(
        sizes.join(total, "root").select(
            "v",
            "root",
            F.greatest(F.ceil(F.col("shingles") / GROUP_SHINGLES), F.ceil(F.col("members") / GROUP_DOCS)).cast("int").alias("blocks"),
        ),
        "groups",
    )
    texts = base.join(placed.select(F.col("v").alias("doc_id"), F.col("root").alias("comp")), "doc_id").select("comp", "doc_id", "text")
    sets = texts.mapInArrow(_text.frugal(_set_blobs), "comp long, rep long, set binary")
    large = placed.where("blocks > 1").groupBy(F.col("root").alias("comp")).agg(F.max("blocks").alias("blocks"))
    giant = bool(large.limit(1).count())
    if giant:
        sets = materialise(sets, "sets")
    schema = "a long, b long"

    def confirm(rows: DataFrame, asked: bool = False) -> DataFrame:
        return rows.repartition("key1", "key2").sortWithinPartitions("key1", "key2").mapInArrow(_text.frugal(_confirm(num, den, asked)), schema)

    small = sets.join(large, "comp", "left_anti") if giant else sets
    links = materialise(confirm(small.select(F.col("comp").alias("key1"), F.lit(0).alias("key2"), "rep", "set")), "links")
    if not giant:
        return links
    # Groups too large for one task: random blocks of bounded size, several times over ...
    big = sets.join(large, "comp")
    for k in range(BLOCK_ROUNDS):
        block = F.pmod(F.xxhash64("rep", F.lit(k)), F.col("blocks")).cast("int")
        links = links.unionByName(materialise(confirm(big.select(F.col("comp").alias("key1"), block.alias("key2"), "rep", "set")), f"blocks{k}"))
    # ... then whatever is not in its group's main part meets every member, outsiders and members in bounded blocks.
    part = components(links).withColumnsRenamed({"v": "rep"})
    labelled = big.join(part, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    counts = labelled.groupBy("comp", "root").count()
    main = counts.groupBy("comp").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("main"))
    split = materialise(labelled.join(main, "comp").select("comp", "blocks", "rep", "set", (F.col("root") != F.col("main")).alias("asked")), "split")
    chunk = F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("blocks"))
    out = split.where("asked").select("comp", "blocks", "rep", "set", chunk.alias("chunk"))
    chunks = out.select("comp", "chunk").distinct()
    every = split.withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")))
    asking = out.select("comp", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "set", F.lit(True).alias("asked"))
    facing = every.join(chunks, "comp").where(~(F.col("asked") & (F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("blocks")) == F.col("chunk")))).select(
        "comp", "chunk", "block", "rep", "set", F.lit(False).alias("asked")
    )
    met = asking.unionByName(facing).select("comp", F.xxhash64("chunk", "block").alias("key2"), "rep", "set", "asked").withColumnRenamed("comp", "key1")
    return links.unionByName(materialise(confirm(met, asked=True), "outsiders"))
