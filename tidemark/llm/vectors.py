"""Near-duplicate vectors: int8 tile products with an error bound for each vector, full precision for what may pass.

A unit vector v is written s*q + e with q of whole numbers from -127 to 127. As v.w = (s q).(t r) + e.(t r) + (s q).f + e.f,
the int8 product is off by at most |e|(1+|f|) + (1+|e|)|f| + |e||f|, where |e| and |f| are measured for each vector. Pairs
whose product plus bound reaches the threshold, and only those, are computed anew in double precision.

Equal unit vectors collapse to one that stands for all their ids. What is left is dealt to cells by the nearest pivot (k-means on
a sample of ``SAMPLE`` vectors; the pivots grow with the table, up to ``MOST_PIVOTS``); small cells share a tile and large ones
are cut into tiles of a bounded size. By the triangle inequality of angles, a vector can only link with one of another cell if it
is no farther from that cell's pivot than the cell's radius and the threshold's angle together; it travels to no other cell's
tiles, and once to a tile that several share. Tiles meet in pairs, each in a task of bounded size that returns counts and a
spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, hook
from ._shared import hashed_sample, materialise

#: Pivots: about one for so many vectors, between the least and the most.
ROWS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 4096, 32, 512
SAMPLE = 4096
#: Numbers in a tile at most (32,768 rows of 64 numbers), rows in one at least where there are cores for more tiles, and rows in
#: a step of its product.
TILE = 1 << 21
LEAST_TILE_ROWS = 1024
INNER = 1024
SALTS = 32
#: Rounding allowed for in single-precision products and in angles.
SLACK = 1e-5


def unit_rows(column: pa.Array) -> tuple[list, list[int]]:
    """Usable rows of a list column: numbers of those that are not null, hold no null or non-finite value and are not zero."""
    flat = column.flatten()
    if len(column) and not column.null_count and not flat.null_count and len(flat) % len(column) == 0:
        width = len(flat) // len(column)
        if width and (column.value_lengths().to_numpy() == width).all():
            grid = flat.to_numpy().reshape(-1, width)
            return list(grid), np.flatnonzero(np.isfinite(grid).all(1) & grid.any(1)).tolist()
    rows = [None if x is None or None in x else np.asarray(x, np.float64) for x in column.to_pylist()]
    good = [i for i, x in enumerate(rows) if x is not None and len(x) and np.isfinite(x).all() and x.any()]
    return rows, good


def pivots(sample: np.ndarray, k: int = LEAST_PIVOTS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, started by farthest points."""
    centres = sample[:1]
    near = sample @ centres[0]
    while len(centres) < min(k, len(sample)):
        far = int(np.argmin(near))
        centres = np.vstack([centres, sample[far]])
        near = np.maximum(near, sample @ sample[far])
    for _ in range(rounds):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _place(shared):
    """Usable rows as unit vectors with their cell, their angle from its pivot and a fingerprint of the unit vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = unit_rows(batch.column(1))
            ids = batch.column(0).to_pylist()
            good = [i for i in good if ids[i] is not None]
            by: dict[int, list[int]] = {}
            for i in good:
                by.setdefault(len(rows[i]), []).append(i)
            for dim, members in by.items():
                v = np.stack([rows[i] for i in members])
                v = v / np.abs(v).max(axis=1, keepdims=True)
                unit = v / np.linalg.norm(v, axis=1, keepdims=True) + 0.0  # no negative zeros
                home, angle = np.zeros(len(v), np.int32), np.zeros(len(v))
                centres = shared.value.get(dim)
                if centres is not None:
                    cos = unit @ centres.T
                    home = np.argmax(cos, axis=1).astype(np.int32)
                    angle = np.arccos(np.clip(cos[np.arange(len(v)), home], -1, 1))
                blobs = [x.tobytes() for x in unit]
                prints = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in blobs), np.int64).reshape(-1, 2)
                columns = [
                    pa.array([ids[i] for i in members], pa.int64()), pa.array(np.full(len(v), dim, np.int32)), pa.array(home), pa.array(angle),
                    pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(blobs, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "home", "angle", "fp1", "fp2", "unit"])

    return work


def packed(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``(group of each cell, tiles of each group)``: neighbouring cells share a group of about ``limit`` rows, in one tile; a
    cell of more rows is a group of its own, in as many tiles as it takes."""
    group, tiles, held = np.zeros(len(rows), np.int32), [], limit
    for c, n in enumerate(rows.tolist()):
        if n > limit or held + n > limit:
            tiles.append(max(1, -(-n // limit)))
            held = n if n <= limit else limit
        else:
            held += n
        group[c] = max(0, len(tiles) - 1)
    return group, np.array(tiles)


def _reach(shared, gap: float):
    """``mine``, the group of a row's cell, and ``cells``, the other groups where it may have links, by its angle from their
    pivots and their radii."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home = batch.column("dim").to_numpy(), batch.column("home").to_numpy()
            blobs = batch.column("unit")
            mine = np.zeros(batch.num_rows, np.int32)
            cells: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for dim in np.unique(dims):
                if int(dim) not in shared.value:
                    continue
                centres, radius, group = shared.value[int(dim)]
                at = np.flatnonzero(dims == dim)
                for part in np.split(at, range(1024, len(at), 1024)):
                    unit = np.stack([np.frombuffer(blobs[int(i)].as_buffer(), np.float64) for i in part])
                    near = np.arccos(np.clip(unit @ centres.T, -1, 1)) <= radius + gap
                    mine[part] = group[home[part]]
                    for i, hit in zip(part, near, strict=True):
                        found = np.unique(group[hit])
                        cells[i] = found[found != mine[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine), pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "mine", "cells"])

    return work


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(q as float32 whole numbers, scale, |error|)`` of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-12


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int8 rows: single-precision sums of at most 1024 products of whole numbers below 2**24."""
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, a.shape[1], 1024):
        part = a[:, lo : lo + 1024].astype(np.float32) @ b[:, lo : lo + 1024].astype(np.float32).T
        out = part if a.shape[1] <= 1024 else out + part.astype(np.float64)
    return out


def _tile_rows(dim: int) -> int:
    return max(16, min(65536, TILE // dim))


LINKS = "id long, other long, links long, fp1 long, fp2 long, to1 long, to2 long"


def _tiles(threshold: float):
    """Links of two tiles, or of one with itself: for each row the ids that it links with and another row of its class; and
    for sets that hold an id of several vectors, each link by itself (``to``), as only distinct ids count there."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        ids, weight, torn, fp1, fp2 = (table[c].to_numpy()[order] for c in ("id", "n", "torn", "fp1", "fp2"))
        n_left = int((side == 0).sum())
        alone = key[1].as_py() == key[2].as_py()
        told: list[np.ndarray] = []
        count, label = np.zeros(len(ids)), np.arange(len(ids))
        if alone or 0 < n_left < len(ids):
            unit = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in table["unit"]])[order]
            q, s, e = quantise(unit)
            right = (0, n_left) if alone else (n_left, len(ids))
            for x0 in range(0, n_left, INNER):
                x1 = min(x0 + INNER, n_left)
                for y0 in range(x0 if alone else right[0], right[1], INNER):
                    y1 = min(y0 + INNER, right[1])
                    near = tile_product(q[x0:x1], q[y0:y1]) * s[x0:x1, None] * s[None, y0:y1]
                    ex, ey = e[x0:x1, None], e[None, y0:y1]
                    i, j = np.nonzero(near + (ex * (1 + ey) + (1 + ex) * ey + ex * ey) + SLACK >= threshold)
                    if not len(i):
                        continue
                    if len(i) * 8 > near.size:
                        cos = (unit[x0:x1] @ unit[y0:y1].T)[i, j]
                    else:
                        cos = np.concatenate([np.einsum("ij,ij->i", unit[x0 + i[k : k + 65536]], unit[y0 + j[k : k + 65536]]) for k in range(0, len(i), 65536)])
                    i, j = i + x0, j + y0
                    keep = cos >= threshold
                    if alone:
                        keep &= i < j
                    i, j = i[keep], j[keep]
                    count += np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                    hook(label, i, j)
                    some = torn[i] | torn[j]
                    told.append(np.stack([i[some], j[some]]))
        some = np.flatnonzero((count > 0) | (label != np.arange(len(ids))))
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *told], axis=1)
        rest = [None] * len(some)
        pairs = [None] * (2 * len(a))
        join = lambda x, y: pa.array([*x, *y], pa.int64())
        return pa.table(
            {
                "id": join(ids[some].tolist(), pairs), "other": join(ids[label[some]].tolist(), pairs), "links": join(count[some].astype(np.int64).tolist(), pairs),
                "fp1": join(fp1[some].tolist(), fp1[np.append(a, b)].tolist()), "fp2": join(fp2[some].tolist(), fp2[np.append(a, b)].tolist()),
                "to1": join(rest, fp1[np.append(b, a)].tolist()), "to2": join(rest, fp2[np.append(b, a)].tolist()),
            }
        )

    return work


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: n_links (other ids of cosine >= threshold), component_id, kept.

    Null and zero vectors, those with null or non-finite components and those with a null id link with nothing (a null id's
    component is null, and it is kept). Vectors of different lengths never link. Rows that repeat an id are one vertex, with the
    links of all its vectors; they do not link with each other, each id counts once, and each row gives a row. Other columns are
    not read; an empty table gives an empty result. Vectors may have any length; a tile holds fewer of the longer ones.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    by_dim: dict[int, list[np.ndarray]] = {}
    for row in hashed_sample(base.where("v is not null"), "id", SAMPLE).select("v").toLocalIterator():
        x = np.array([np.nan if c is None else c for c in row["v"]], np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            by_dim.setdefault(len(x), []).append(x / np.linalg.norm(x))
    k = min(MOST_PIVOTS, max(LEAST_PIVOTS, base.count() // ROWS_A_PIVOT))
    centres = {dim: pivots(np.stack(x), k) for dim, x in by_dim.items()}
    placed = materialise(
        base.mapInArrow(_place(spark.sparkContext.broadcast(centres)), "id long, dim int, home int, angle double, fp1 long, fp2 long, unit binary"), "vectors"
    )
    fp = ["fp1", "fp2"]
    member = placed.select("id", *fp).distinct()
    torn = member.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("torn"))
    member = materialise(member.join(torn, "id", "left").withColumn("torn", F.coalesce("torn", F.lit(False))), "members")
    sets = member.groupBy(*fp).agg(
        F.min("id").alias("rep"), F.sum((~F.col("torn")).cast("long")).alias("n"), F.count("*").alias("size"), F.max("torn").alias("torn")
    )
    # one row stands for each set; of a repeated row any
    first = placed.join(sets.select(*fp, F.col("rep").alias("id"), "n", "torn"), [*fp, "id"]).dropDuplicates(fp)
    # of each cell its rows and radius: at most MOST_PIVOTS rows for each length that the sample holds, and one for any other
    cells = first.groupBy("dim", "home").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    known = cells.where(F.col("dim").isin(list(centres))).collect() if centres else []
    spread = math.ceil((6 * spark.sparkContext.defaultParallelism) ** 0.5)  # so many tiles meet in some three tasks a core
    reach, grouped = {}, []
    for dim, points in centres.items():
        radius, held = np.full(len(points), -10.0), np.zeros(len(points), np.int64)  # nothing is near an empty cell
        for r in known:
            if r["dim"] == dim:
                radius[r["home"]], held[r["home"]] = r["radius"], r["rows"]
        group, count = packed(held, min(_tile_rows(dim), max(LEAST_TILE_ROWS, -(-int(held.sum()) // spread))))
        reach[dim] = (points, radius, group)
        grouped += [(dim, g, int(n)) for g, n in enumerate(count)]
    gap = float(np.arccos(min(1.0, threshold))) + SLACK
    near = first.mapInArrow(_reach(spark.sparkContext.broadcast(reach), gap), "fp1 long, fp2 long, id long, dim int, home int, angle double, unit binary, n long, torn boolean, mine int, cells array<int>").drop("home", "angle")
    tile = F.pmod(F.xxhash64(*fp), F.col("tiles")).cast("int").alias("tile")
    # each row meets all tiles of its own group and of the groups that it can reach
    tiles = F.broadcast(spark.createDataFrame(grouped, "dim int, cell int, tiles int"))
    sampled = near.where(F.col("dim").isin(list(centres))).join(tiles.withColumnRenamed("cell", "mine"), ["dim", "mine"])
    sampled = sampled.select("id", "dim", *fp, "unit", "n", "torn", "mine", tile, F.explode(F.concat(F.array("mine"), "cells")).alias("cell"))
    sampled = sampled.join(tiles.withColumnRenamed("tiles", "there"), ["dim", "cell"])
    # a length that the sample lacks is one cell
    alone = cells.where(~F.col("dim").isin(list(centres))).select("dim", F.expr(f"cast(ceil(rows / greatest(16, least(65536, {TILE} div dim))) as int)").alias("tiles"))
    alone = near.where(~F.col("dim").isin(list(centres))).join(alone, "dim")
    alone = alone.select("id", "dim", *fp, "unit", "n", "torn", "mine", tile, F.col("mine").alias("cell"), F.col("tiles").alias("there"))
    met = sampled.unionByName(alone).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
    code = lambda home, t: F.col(home).cast("long") * (1 << 32) + F.col(t)
    mine, theirs = code("mine", "tile"), code("cell", "t")
    met = met.select("dim", F.least(mine, theirs).alias("x"), F.greatest(mine, theirs).alias("y"), (mine > theirs).cast("int").alias("side"), "id", "n", "torn", *fp, "unit")
    met = materialise(met.groupBy("dim", "x", "y").applyInArrow(_tiles(threshold), LINKS), "links")

    ties = member.where("torn").join(sets.select(*fp, "rep"), fp).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = materialise(components(met.where("id is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(ties)), "components")
    links = met.where("id is not null").groupBy(*fp).agg(F.sum("links").alias("links"))
    told = sets.join(links, fp, "left").join(found.withColumnRenamed("v", "rep"), "rep", "left")
    told = told.select(*fp, "rep", "size", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    told = materialise(told, "sets")
    # a set may have copies without number: they are dealt to SALTS tasks, each of which is told the set's links
    salted = told.where("size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    plain = member.where("not torn").select("id", *fp, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    single = told.where("size = 1").select(F.col("rep").alias("id"), "n", "root", *fp)
    counted = plain.join(salted, [*fp, "salt"]).select("id", "n", "root", *fp).unionByName(single.join(torn, "id", "left_anti"))
    if member.where("torn").limit(1).count():
        counted = counted.select("id", "n", "root", *fp)
        ways = met.where("to1 is not null").select(*fp, "to1", "to2").unionByName(sets.where("torn").select(*fp, F.col("fp1").alias("to1"), F.col("fp2").alias("to2"))).distinct()
        there = member.select(F.col("id").alias("to"), F.col("fp1").alias("to1"), F.col("fp2").alias("to2"), F.col("torn").alias("to_torn"))
        extra = ways.join(there.where("to_torn"), ["to1", "to2"]).groupBy(*fp).agg(F.count_distinct("to").alias("extra"))
        counted = counted.join(extra, fp, "left").select("id", (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n"), "root")
        whole = member.where("torn").join(ways, fp).join(there, ["to1", "to2"]).where("id != to").groupBy("id").agg(F.count_distinct("to").alias("n"))
        whole = torn.select("id").join(whole, "id", "left").join(found.withColumnRenamed("v", "id"), "id", "left")
        counted = counted.unionByName(whole.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root")))
    out = base.select("id").join(counted.select("id", "n", "root"), "id", "left")
    root = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), root.alias("component_id"), (F.col("id").isNull() | (F.col("id") == root)).alias("kept")
    )
