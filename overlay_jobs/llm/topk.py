"""Exact top-k by inner product with a pivot-distance index.

One more component makes all vectors equally long, sqrt(M - |v|^2), where M is the largest squared length; a query gets 0 there.
Then the nearest vectors are those with the largest inner products. Pivots come from a bounded sample; every vector is indexed
under its nearest pivot and its distance to it. A pivot's vectors are dealt to slices, so that no task holds more than a slice
however many vectors are equal. A query first searches one slice near it, which bounds its k-th best score; then only the cells
that the triangle inequality leaves open. Queries of a block are near the same pivot, and cells are copied only to the blocks that
ask for them. In a cell, queries at about the same distance from its pivot go together, ring by ring outwards from that distance,
until no ring can win.

Scores are exact: in doubles between vectors whose squared lengths are below 2^52, else in whole numbers of any size. Vectors at or
beyond that have pivots, cells and a unit of their own, so that a few of them neither widen the bounds nor slow the others' scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.session import broadcast_if_small, settle

#: Pivots; rows of the sample that they are chosen from; queries and vectors in a group at most, about; vectors in a ring; queries
#: that go through the rings together.
PIVOTS, SAMPLE_ROWS, QUERY_BLOCK, SLICE_LEAST, SLICE_MOST, RING, TOGETHER = 64, 2_000, 16_384, 64, 65_536, 256, 512
#: Share of the largest length by which distances may be off in doubles.
SLACK = 1e-6
#: Below every score; what makes a score a text of so many digits that sorts like it.
NOTHING, OFFSET, DIGITS = float("-inf"), 10**624, 625
#: Vectors of squared lengths below this have exact inner products in doubles; doubles from WHOLE on are whole.
EXACT, WHOLE = 2.0**52, 2.0**53
#: What longs end at.
LEAST, MOST = -(2**63), 2**63 - 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    flat = np.asarray(column.flatten(), np.float64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _far(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    square = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _lift(v: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0))])


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Means of a few rounds of nearest-mean grouping, begun at evenly spaced rows of the sample."""
    means = sample[np.unique(np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int))]
    for _ in range(rounds):
        near = _far(sample, means).argmin(axis=1)
        means = np.array([sample[near == i].mean(axis=0) if (near == i).any() else m for i, m in enumerate(means)])
    return means


def _whole(v: np.ndarray) -> np.ndarray:
    """The same as Python's whole numbers, which have no largest one."""
    return np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape)


def _radius(norm: np.ndarray, most: float, kth: np.ndarray) -> np.ndarray:
    """How far a vector may be that reaches a score, with room for rounding."""
    return np.sqrt(np.maximum(norm + most - 2 * kth, 0)) * (1 + 1e-9) + SLACK * np.sqrt(most) + 1e-6


def _asking(q: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """Queries scaled by powers of two, and these: near 1 for cells of large vectors, else at most 2^26."""
    exponent = np.frexp(np.abs(q).max(axis=1, initial=0))[1]
    scale = np.ldexp(1.0, -exponent if large else np.minimum(26 - exponent, 0))
    return q * scale[:, None], scale


def _square(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (v**2).sum(axis=1)


def _search(queries: pa.Table, cell: pa.Table, dim: int, most: float, unit: float, large: bool, k: int) -> pa.Table:
    """Best k of a slice for each of the queries that came to it."""
    schema = pa.schema([("asker", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.string())])
    if not queries.num_rows or not cell.num_rows:
        return schema.empty_table()
    order = np.argsort(np.asarray(cell["far"]), kind="stable")
    far, ids, rows = (np.asarray(cell[name])[order] for name in ("far", "id", "row"))
    v = _matrix(cell["v"], dim)[order]
    q, own, name, at, floor = _matrix(queries["q"], dim), *(np.asarray(queries[c]) for c in ("asker", "query_id", "away", "floor"))
    whole = large | ~(_square(q) < EXACT)
    out = []
    for exact in (False, True):
        near = np.flatnonzero(whole == exact)
        near = near[np.argsort(at[near], kind="stable")]
        for i in range(0, len(near), TOGETHER):
            part = near[i : i + TOGETHER]
            row, *cols = _rings(q[part], own[part], at[part], floor[part], v, far, ids, rows, most, unit, large, exact, k)
            out.append((own[part][row], name[part][row], *cols))
    return pa.concat_tables([pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema) for cols in out])


def _bound(x: int) -> float:
    """A double that is no larger."""
    return float("-inf") if x < -(10**300) else float(min(x, 10**300))


def _rings(q: np.ndarray, own: np.ndarray, at: np.ndarray, floor: np.ndarray, v: np.ndarray, far: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: float, unit: float, large: bool, exact: bool, k: int) -> tuple:
    scaled, scale = _asking(q, large)
    norm = _square(scaled)
    kind, none = (object, -(10**700)) if exact else (np.float64, -np.inf)
    best = np.full((len(q), k), none, kind)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    whole_q = _whole(q) if exact else q
    rings = [(i, min(i + RING, len(v))) for i in range(0, len(v), RING)]
    mid = np.median(at)
    for a, b in sorted(rings, key=lambda r: max(far[r[0]] - mid, mid - far[r[1] - 1], 0)):
        # the k-th best so far as a distance; a ring nearer to or farther from the pivot by more than that can't win
        kth = np.maximum(np.array([_bound(x) for x in best[:, -1]]) if exact else best[:, -1], floor)
        radius = _radius(norm, most, kth * scale / unit)
        open_ = np.flatnonzero((far[a] - at <= radius) & (at - far[b - 1] <= radius))
        if not len(open_):
            continue
        scores = whole_q[open_] @ (_whole(v[a:b]) if exact else v[a:b]).T
        scores[own[open_][:, None] == rows[None, a:b]] = none
        all_s = np.concatenate([best[open_], scores], axis=1)
        all_i = np.concatenate([best_id[open_], np.broadcast_to(ids[a:b], scores.shape)], axis=1)
        if exact:
            pick = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(all_s.tolist(), all_i.tolist())])
        else:
            if all_s.shape[1] > 4 * k:  # only scores that reach the k-th best matter
                cut = np.partition(all_s, -k, axis=1)[:, -k][:, None]
                drop = all_s < cut
                all_s, all_i = np.where(drop, -np.inf, all_s), np.where(drop, np.iinfo(np.int64).max, all_i)
            pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best[open_], best_id[open_] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
    row, col = np.nonzero(best > none)
    found = best[row, col]
    if not exact:
        return row, best_id[row, col], found.astype(np.int64), [""] * len(row)
    # longs say all of a score but at their ends, where its digits tell the rest
    texts = ["" if LEAST < x < MOST else f"{x + OFFSET:0{DIGITS}d}" for x in found.tolist()]
    return row, best_id[row, col], [min(max(x, LEAST), MOST) for x in found.tolist()], texts


def top_k(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `asked` selects its k best other rows by the inner product of
    components floor(scale * x); ties go to the smaller id.

    Vectors that are null or hold null or non-finite components (scaled ones included), and rows with a null id, take no part;
    shorter vectors count as padded with zeros. Rows are what counts, not ids: each asked row is a query of its own, whose
    candidates are all rows but itself, those with its id included; repeated candidates each count; fewer than k candidates give
    fewer rows; an empty table or no query gives an empty result; other columns are not read. Scores beyond a long are ranked by
    their whole value and returned as the nearest long.
    """
    spark = vectors.sparkSession

    def scaled(c: Column) -> Column:
        y = c.cast("double") * scale
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)  # beyond 2^53 doubles are whole

    fine = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float("inf")))
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), scaled).alias("v"), asked.alias("asked"), F.monotonically_increasing_id().alias("row"))
    own = settle(own.withColumn("square", F.aggregate("v", F.lit(0.0), lambda total, c: total + c * c)), "top-vectors")
    own = own.withColumn("large", ~(F.col("square") < EXACT))
    most, longest = F.max(F.when(~F.col("large"), F.col("square"))), F.max(F.when(F.col("large"), F.array_max(F.transform("v", F.abs))))
    n, most, longest, dim, n_asked = own.agg(F.count("*"), most, longest, F.max(F.size("v")), F.count_if("asked")).head()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # large or not: squared length at most, both in units of `unit`
    kinds = {False: (most, 1.0)} if most is not None else {}
    if longest is not None:
        kinds[True] = (float(dim), float(np.ldexp(1.0, np.frexp(longest)[1]))) if longest < 2.0**1023 else (4.0 * dim, 2.0**1023)
    pivots, indexes = {}, []

    def nearest(large: bool):  # noqa: ANN202
        top, unit = kinds[large]

        @F.arrow_udf("struct<pivot: int, far: double>")
        def place(v: pa.Array) -> pa.Array:
            far = _far(_lift(_matrix(v, dim) / unit, top), pivots[large])
            near = far.argmin(axis=1) if len(far) else np.zeros(0, int)
            return pa.StructArray.from_arrays([pa.array((near + PIVOTS * large).astype(np.int32)), pa.array(far[np.arange(len(far)), near])], ["pivot", "far"])

        return place

    for large, (top, unit) in kinds.items():
        mine = own.where(F.col("large") == large)
        sample = mine.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).toArrow()
        pivots[large] = choose_pivots(_lift(_matrix(sample["v"], dim) / unit, top))

        indexes.append(mine.select("id", "row", "v", "asked", nearest(large)("v").alias("n")).select("id", "row", "v", "asked", "n.*"))
    index = settle(indexes[0] if len(indexes) == 1 else indexes[0].unionByName(indexes[1]), "top-index")
    cells = index.groupBy("pivot").agg(F.count("*"), F.min("far"), F.max("far")).collect()  # one row per pivot
    slice_rows = min(max(n // 128, SLICE_LEAST), SLICE_MOST)
    cell = {p: (-(-rows // slice_rows), lo, hi) for p, rows, lo, hi in cells}
    dealt = F.create_map(*(F.lit(y) for p, (slices, _, _) in cell.items() for y in (p, slices)))
    placed = index.select("id", "row", "v", "pivot", "far", F.pmod(F.xxhash64("row", F.lit(7)), dealt[F.col("pivot")]).cast("int").alias("slice"))
    # queries of a pivot are blocks of their own, so that a block asks for few cells
    homes = index.where("asked").groupBy("pivot").count().collect()  # one row per pivot
    parts = F.create_map(*(F.lit(y) for p, rows in homes for y in (p, -(-rows // QUERY_BLOCK))))
    part = F.pmod(F.xxhash64("row", F.lit(11)), parts[F.col("pivot")]) * (2 * PIVOTS) + F.col("pivot")
    queries = index.where("asked").select(F.col("row").alias("asker"), F.col("id").alias("query_id"), F.col("v").alias("q"), part.cast("int").alias("part"))

    def routes(first: bool):  # noqa: ANN202
        @F.arrow_udf("array<struct<pivot: int, far: double, slice: int>>")
        def route(v: pa.Array, floor: pa.Array, ids: pa.Array) -> pa.Array:
            q = _matrix(v, dim)
            floors = floor.to_numpy(zero_copy_only=False).astype(np.float64)
            out = [[] for _ in range(len(q))]
            for large, (top, unit) in list(kinds.items())[: 1 if first else None]:
                scaled, scale = _asking(q, large)
                far = _far(np.column_stack([scaled, np.zeros(len(q))]), pivots[large])
                radius = _radius(_square(scaled), top, floors * scale / unit)
                cells = [p for p in cell if (p >= PIVOTS) == large]
                for i, row in enumerate(far):
                    away = {p: row[p - PIVOTS * large] for p in cells}
                    home = min(cells, key=lambda p: away[p])
                    if first:
                        out[i].append({"pivot": home, "far": away[home], "slice": int(ids[i].as_py() % cell[home][0])})
                        continue
                    for p in cells:
                        slices, lo, hi = cell[p]
                        if max(away[p] - hi, lo - away[p], (away[p] - away[home]) / 2) <= radius[i]:
                            out[i] += [{"pivot": p, "far": away[p], "slice": s} for s in range(slices)]
            return pa.array(out, pa.list_(pa.struct([("pivot", pa.int32()), ("far", pa.float64()), ("slice", pa.int32())])))

        return route

    def search(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        large = key[0].as_py() >= PIVOTS
        return _search(q, c, dim, *kinds[large], large, k)

    def visit(asking: DataFrame, first: bool) -> DataFrame:
        own = ("asker", "query_id", "q", "part", "floor")
        sent = asking.select(*own, F.explode(routes(first)("q", "floor", "asker")).alias("r")).select(*own, F.col("r.pivot").alias("to"), F.col("r.slice").alias("at"), F.col("r.far").alias("away"))
        sent = settle(sent, "top-sent")
        asked_for = sent.select(F.col("to").alias("of"), F.col("at").alias("cut"), F.col("part").alias("block")).distinct()
        asked_for = broadcast_if_small(settle(asked_for, "top-asked-for"))
        copied = placed.join(asked_for, (F.col("pivot") == F.col("of")) & (F.col("slice") == F.col("cut"))).select("id", "row", "v", "far", "pivot", "slice", "block")
        return sent.groupBy("to", "at", "part").cogroup(copied.groupBy("pivot", "slice", "block")).applyInArrow(search, "asker long, query_id long, vec_id long, score long, exact string")

    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    seen = visit(queries.withColumn("floor", F.lit(NOTHING)), True).groupBy(F.col("asker").alias("who")).agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    bound = F.when((F.col("n") >= k) & (F.col("worst") > LEAST), F.col("worst").cast("double"))
    asking = settle(queries.join(seen, F.col("asker") == F.col("who"), "left").select("asker", "query_id", "q", "part", F.coalesce(bound, F.lit(NOTHING)).alias("floor")), "top-bounds")
    ranked = visit(asking, False).select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
