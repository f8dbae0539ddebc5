"""The k nearest rows of every row, exactly, by pivots and the triangle inequality.

Equal vectors are one class, so that a vector that a third of all rows share is searched
once. Classes go to the nearest of some pivots; a pivot's rows are dealt into blocks of
bounded size. Within its own block a row finds a bound for its k-th neighbour; by that
bound, distances to pivots and the pivots' radii it asks only blocks that can hold a nearer
row. A task holds one tile of asking blocks against one tile of blocks, block by block, by
matrix products, and hands on the best of each asking row. So vectors move, once for each
tile that they meet, and never pairs.

Where all rows are about equally far apart, as noise in many dimensions is, bounds exclude
little, and the work is all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.sources.scratch import materialise

#: Rows of a block, pivots at most, and blocks of a tile at most.
BLOCK, PIVOTS, TILE = 2048, 4096, 16
#: Share of the distances by which products of matrices may be off; for short numbers, of the
#: squares, by dimension; and pairs whose distances are taken at once.
SLACK, ROUNDING, PAIRS = 1e-6, 2.0**-22, 1 << 17


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))


def closest(x: np.ndarray, y: np.ndarray, k: int, limit: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], meets: list[tuple[np.ndarray, int, int]] | None = None, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the ``k`` rows of ``y`` that are nearest to each of ``x``
    and within ``limit``, of equally near ones the first, or those of the least ``rank``.
    ``meets`` may say which rows of ``x`` meet which stretch of ``y``. Matrix products of short numbers
    find who may be among them, by bounds that fall from stretch to stretch and leave room for
    all that such numbers can be off; ``exact`` gives distances of pairs, some at a time."""
    found = ([], [], [])
    if not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    # Of a size that short numbers hold; a power of two changes no digit.
    largest = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    unit = float(np.ldexp(1.0, min(1000, -int(np.frexp(largest)[1])))) if 0 < largest < np.inf else 1.0
    x_size, y_size = (((z * unit) ** 2).sum(1) for z in (x, y))
    left = np.column_stack([x * unit, x_size, np.ones(len(x))]).astype(np.float32)
    right = np.column_stack([-2 * (y * unit), np.ones(len(y)), y_size]).astype(np.float32)
    rank = np.arange(len(y)) if rank is None else rank
    room = ROUNDING * (x.shape[1] + 8) * (x_size + np.fmax.reduce(y_size)) + 1e-30
    within = (limit * unit) ** 2 + room
    if meets is None:
        meets = [(np.arange(len(x)), at, min(at + BLOCK, len(y))) for at in range(0, len(y), BLOCK)]
    for lo in range(0, len(x), BLOCK):
        hi = min(lo + BLOCK, len(x))
        kept, bound, slack, cut_at = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)), within[lo:hi].copy(), room[lo:hi], 1
        for seen, (rows, start, end) in enumerate(meets, 1):
            own = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi)] - lo
            if not len(own):
                continue
            far = left[lo:hi][own] @ right[start:end].T
            if not len(kept[0]) and k < end - start:
                bound[own] = np.minimum(bound[own], np.partition(far, k - 1, axis=1)[:, k - 1] + 2 * slack[own])
            # A bound is rounded up, never down.
            place = _places(far <= np.nextafter(bound[own].astype(np.float32), np.float32(np.inf))[:, None])
            kept = tuple(np.append(a, b) for a, b in zip(kept, (own[place // (end - start)], place % (end - start) + start, far.ravel()[place]), strict=True))
            if seen >= cut_at or len(kept[0]) > PAIRS:
                kept, cut_at = _within(*kept, k, bound, slack), 2 * seen
            if len(kept[0]) > PAIRS:  # many may be equally near
                best, _ = _best(*kept[:2], k, rank, lambda r, c, lo=lo: exact(r + lo, c))
                kept = tuple(a[best] for a in kept)
        row, col, _ = _within(*kept, k, bound, slack)
        best, distance = _best(row, col, k, rank, lambda r, c, lo=lo: exact(r + lo, c))
        for part, own in zip(found, (row[best] + lo, col[best], distance), strict=True):
            part.append(own)
    return np.concatenate(found[0]), np.concatenate(found[1]), np.concatenate(found[2])


def _places(hit: np.ndarray) -> np.ndarray:
    """As ``np.flatnonzero``, for few hits among many: eight are passed over at a time."""
    hit = hit.ravel()
    whole = len(hit) // 8 * 8
    at = (np.flatnonzero(hit[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.append(at[hit[at]], np.flatnonzero(hit[whole:]) + whole)


def _within(row: np.ndarray, col: np.ndarray, far: np.ndarray, k: int, bound: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that may still be among a row's ``k`` nearest; lowers the rows' bounds."""
    order = np.lexsort((far, row))
    row, col, far = row[order], col[order], far[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == k - 1
    bound[row[last]] = np.minimum(bound[row[last]], far[last] + 2 * slack[row[last]])
    stay = far <= bound[row]
    return row[stay], col[stay], far[stay]


def _best(row: np.ndarray, col: np.ndarray, k: int, rank: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ``k`` nearest of each row's pairs; rows lie together."""
    distance = np.concatenate([np.zeros(0), *(exact(row[at : at + PAIRS], col[at : at + PAIRS]) for at in range(0, len(row), PAIRS))])
    order = np.lexsort((rank[col], distance, row))
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return order, distance[order]


def rank_of(ids: pa.ChunkedArray) -> np.ndarray:
    """Each id's place in the order of the ids."""
    order = pc.sort_indices(ids).to_numpy()
    out = np.empty(len(order), int)
    out[order] = np.arange(len(order))
    return out


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids, n): of each different vector the least id, and the first k + 1 ids."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("_r", place).where(F.col("_r") <= k + 1)
    return materialise(first.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")).select("rep", "v", "ids", F.size("ids").alias("n")), "vector-classes")


def nearest_to_all(df: DataFrame, ident: str, vector: str, k: int, metric: str = "euclid", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(ident, rank, neighbour, distance) of every row: its ``k`` nearest others, of equally
    near ones those with the least ids. Null vectors, and for cosines those without length,
    neither ask nor answer."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), v.alias("v"))
    if metric == "cosine":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("_l", length).where("_l > 0").select("id", F.transform("v", lambda x: x / F.col("_l")).alias("v"))
    rows = rows.select("id", F.transform("v", lambda x: x + 0.0).alias("v"))  # one zero, not two
    spark, kind = df.sparkSession, df.schema[ident].dataType.simpleString()
    classes = classes_of(rows, k)
    n = classes.count()
    if not n:
        return spark.createDataFrame([], f"`{ident}` {kind}, rank int, neighbour {kind}, distance double")
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(pivots, -(-n // block))).collect()  # at most ``pivots`` vectors
    p = np.array([r["v"] for r in chosen])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = _distances(_matrix(b.column("v")), p) if len(b) else np.zeros((0, len(p)))
            own = far.argmin(1) if len(b) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(b)), own])], [*b.schema.names, "cell", "far"])

    dealt = classes.select("rep", "v", "n").mapInArrow(home, f"rep {kind}, v array<double>, n int, cell int, far double")
    dealt = materialise(dealt, "cells")
    stats = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("rows")).collect()  # a row for each pivot
    radius, blocks = np.full(len(p), -np.inf), np.zeros(len(p), int)
    for r in stats:
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["rows"] // block)
    first = np.cumsum(blocks) - blocks  # blocks are numbered through all cells
    parts = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell"))
    start = F.get(F.array(*[F.lit(int(f)) for f in first]), F.col("cell"))
    if len(p) > 64:  # a table rather than a long expression; a row for each pivot
        cells = F.broadcast(spark.createDataFrame([(i, int(b), int(f)) for i, (b, f) in enumerate(zip(blocks, first, strict=True))], "cell int, _parts int, _start int"))
        dealt = dealt.join(cells, "cell").withColumn("block", (F.col("_start") + F.pmod(F.xxhash64("rep"), F.col("_parts"))).cast("int")).drop("_parts", "_start")
    else:
        dealt = dealt.withColumn("block", (start + F.pmod(F.xxhash64("rep"), parts)).cast("int"))

    def bound(key: tuple, t: pa.Table) -> pa.Table:
        """Each row's distance within which its block holds k others."""
        x, n_of = _matrix(t["v"]), t["n"].to_numpy()
        far = _distances(x, x)
        order = np.argsort(far, axis=1, kind="stable")[:, : k + 1]
        held = np.cumsum(n_of[order], axis=1)
        at = (held < k + 1).sum(1)
        limit = np.where(at < order.shape[1], far[np.arange(len(x)), order[np.arange(len(x)), np.minimum(at, order.shape[1] - 1)]], np.inf)
        return t.append_column("limit", pa.array(limit))

    bounded = materialise(dealt.groupBy("block").applyInArrow(bound, f"{_ddl(dealt)}, limit double"), "bounds")
    between = _distances(p, p)

    cell_of = np.repeat(np.arange(len(p)), blocks)
    # Tiles of like size, and enough pairs of them for all cores.
    size = int(max(1, min(TILE, blocks.sum() // np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))))

    def needs(x: np.ndarray, own: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Rows by cells: whether a cell may hold a nearer row."""
        far = _distances(x, p)
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.nan_to_num((far**2 - far[np.arange(len(x)), own][:, None] ** 2) / (2 * between[own]), nan=-np.inf, posinf=-np.inf)
        return (np.maximum(far - radius[None, :], beyond) <= limit[:, None] + SLACK * (1 + far)) & (blocks > 0)[None, :]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles that a tile's rows ask; numbers alone leave the task."""
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                some = b.slice(lo, BLOCK)
                row, cell = np.nonzero(needs(_matrix(some.column("v")), some.column("cell").to_numpy(), some.column("limit").to_numpy()))
                asks, cell = np.unique(np.column_stack([some.column("block").to_numpy()[row] // size, cell]), axis=0).T if len(row) else (row, cell)
                # A cell's blocks follow one another, and so do their tiles.
                tiles = [np.arange(first[c] // size, (first[c] + blocks[c] - 1) // size + 1) for c in cell]
                of = np.concatenate(tiles) if tiles else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks, [len(t) for t in tiles]).astype(np.int32)), pa.array(of.astype(np.int32))], ["asks", "of"])

    # A number for each two tiles, however many rows they have.
    pairs = materialise(bounded.mapInArrow(ask, "asks int, of int").distinct(), "asking")
    tiled = bounded.select("rep", "v", "limit", "cell", "block", F.floor(F.col("block") / size).cast("int").alias("tile"))
    asking = tiled.join(F.broadcast(pairs), F.col("tile") == F.col("asks")).drop("tile")
    other = tiled.select(*[F.col(c).alias(f"t_{c}") for c in ("rep", "v", "block", "tile")])
    wanted = other.join(F.broadcast(pairs.toDF("by", "with")), F.col("t_tile") == F.col("with")).drop("t_tile")

    def answer(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        out, t = [schema.empty_table()], t.rename_columns([c.removeprefix("t_") for c in t.column_names])
        q, t = q.sort_by("block"), t.sort_by([("block", "ascending"), ("rep", "ascending")])
        (_, q_from, q_n), (t_blocks, t_from, t_n) = (np.unique(table["block"].to_numpy(), return_index=True, return_counts=True) for table in (q, t))
        y, rank = _matrix(t["v"]), rank_of(t["rep"])
        for lo, n in zip(q_from, q_n, strict=True):
            own = q.slice(lo, n)
            x, limit = _matrix(own["v"]), own["limit"].to_numpy()
            need = needs(x, own["cell"].to_numpy(), limit)
            meets = [(np.flatnonzero(need[:, cell_of[block]]), at, at + held) for block, at, held in zip(t_blocks, t_from, t_n, strict=True)]
            row, col, far = closest(x, y, k + 1, limit, lambda r, c, x=x: np.sqrt(((x[r] - y[c]) ** 2).sum(1)), meets, rank)
            out.append(pa.table({"rep": own["rep"].take(pa.array(row)), "other": t["rep"].take(pa.array(col)), "distance": far}, schema=schema))
        return pa.concat_tables(out)

    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("rep", ids), ("other", ids), ("distance", pa.float64())])
    met = asking.groupBy("asks", "of").cogroup(wanted.groupBy("by", "with")).applyInArrow(answer, f"rep {kind}, other {kind}, distance double")
    near = F.row_number().over(Window.partitionBy("rep").orderBy("distance", "other"))
    best = met.withColumn("_r", near).where(F.col("_r") <= k + 1).drop("_r")
    # The first k + 1 ids of the nearest classes serve every row of a class.
    each = best.join(classes.select(F.col("rep").alias("other"), "ids"), "other").select("rep", "distance", F.explode("ids").alias("other"))
    each = each.withColumn("_r", near).where(F.col("_r") <= k + 1)
    lists = materialise(each.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near")), "near-lists")
    mine = rows.join(classes.select("rep", "v"), "v").select("id", "rep").join(lists, "rep")
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    out = mine.select("id", F.posexplode(others).alias("at", "x"))
    distance = F.col("x.distance") if metric == "euclid" else F.col("x.distance") ** 2 / 2
    return out.select(F.col("id").alias(ident), (F.col("at") + 1).alias("rank"), F.col("x.other").alias("neighbour"), distance.alias("distance"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)
