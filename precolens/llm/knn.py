"""Exact top-k search by inner product as a Voronoi kNN join.

Inner product becomes distance by one more component: with M the largest squared norm of the data,
data get sqrt(M - |x|^2) and queries 0, and then |q - x|^2 = |q|^2 + M - 2 q.x. Queries and data are
grouped by pivots. From summaries of the data cells (the k + 1 ids nearest to the pivot) follows
a bound on the k-th distance for every group of queries. A data row is sent to a group only if the
triangle inequality leaves it within that bound; each group is solved exactly, in blocks of bounded
size by matrix products, and the blocks' best are merged per query.

Rows alike in id and vector are counted first; of each, k copies suffice. Groups are large, so that a
data row that nothing can prune is sent once for some ten thousand queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precolens.llm.common import ready
from precolens.session import durable

# Pivots of the data cells and, at most, of the query groups; queries and data rows a task solves at once.
DATA_PIVOTS, QUERY_PIVOTS, LEAST_GROUPS = 64, 256, 4
QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 16_384, 50_000
# Scores of a matrix product.
_CELLS = 4 << 20
_EXACT = 2.0**53


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v) of the rows that take part: those with an id and a usable vector."""
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return taken.where(F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False))).select(
        "id", quantised(F.col("v"), scale).alias("v")
    )


class Pivots(NamedTuple):
    """Pivots of queries and data in the space with the added component, and M."""

    query: np.ndarray
    data: np.ndarray
    top: float
    width: int


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as float64, filled with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _added(x: np.ndarray, top: float | None) -> np.ndarray:
    """With the added component: data for a given M, queries for None."""
    extra = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))
    return np.column_stack([x, extra])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _slack(top: float) -> float:
    """More than rounding can move a distance: errors of the squares are some 2^-50 of them."""
    return 1e-5 * (1 + np.sqrt(top))


def _sample(rows: DataFrame, n: int, width: int) -> np.ndarray:
    found = rows.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return _matrix(pa.array([list(r.v) for r in found], pa.list_(pa.int64())), width) if found else np.zeros((0, width))


def _nearest(rows: DataFrame, pivots: Pivots, n: int) -> DataFrame:
    """(cell, id, distance): of every task the ``n`` ids nearest to the pivot of each data cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((3, 0))
        ids = np.zeros(0, np.int64)
        for batch in batches:
            d = _distances(_added(_matrix(batch.column(1), pivots.width), pivots.top), pivots.data)
            cell = d.argmin(axis=1)
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            best = np.hstack([best, [cell, d[np.arange(len(d)), cell], np.zeros(len(d))]])
            order = np.lexsort((best[1], ids, best[0]))
            ids, best = ids[order], best[:, order]
            first = np.append(True, (ids[1:] != ids[:-1]) | (best[0, 1:] != best[0, :-1]))[: len(ids)]
            ids, best = ids[first], best[:, first]
            order = np.lexsort((ids, best[1], best[0]))
            ids, best = ids[order], best[:, order]
            place = np.arange(len(ids)) - np.searchsorted(best[0], best[0])
            ids, best = ids[place < n], best[:, place < n]
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int64)), pa.array(ids), pa.array(best[1])], ["cell", "id", "distance"])

    found = ready(rows).mapInArrow(run, "cell long, id long, distance double")
    found = found.groupBy("cell", "id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= n)


def _placed(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """(no, cell, distance) of the queries: the nearest pivot of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_added(_matrix(batch.column(1), pivots.width), None), pivots.query)
            cell = d.argmin(axis=1)
            near = pa.array(d[np.arange(len(d)), cell])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), near], ["no", "cell", "distance"])

    return ready(rows).mapInArrow(run, "no long, cell long, distance double")


def top_k(queries: DataFrame, data: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each query with rows of other ids.

    Both sides are (id, v) as ``vectors`` gives them. Ties go to the smaller id; fewer rows give fewer
    results; shorter vectors count as filled with zeros. Rows that repeat an id are candidates each.
    Queries that repeat an id and a vector count once; those that repeat an id with another vector
    count each. No queries or no data give no rows. Scores must fit a long.
    """
    copies = data.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    data = durable(copies.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")))
    queries = durable(queries.distinct().select(F.monotonically_increasing_id().alias("no"), "id", "v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = [side.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first() for side in (queries, data)]
    (n_queries, *_), (n_data, _, top) = facts
    width = max(1, *(f[1] or 0 for f in facts))
    groups = min(max(LEAST_GROUPS, -(-n_queries // QUERIES_PER_BLOCK)), QUERY_PIVOTS)
    if not n_queries or not n_data:
        return _ranked(queries.selectExpr("no", "id as query_id", "id", "0L as score").limit(0), k)
    pivots = Pivots(
        _added(_sample(queries, groups, width), None), _added(_sample(data, DATA_PIVOTS, width), top), top, width
    )

    # Summaries: per query group its radius and size, per data cell the nearest ids, DATA_PIVOTS times k + 1 at most;
    # one more than k, since the query's own id may be among them.
    placed = durable(_placed(queries.select("no", "v"), pivots))
    radius = {r.cell: r for r in placed.groupBy("cell").agg(F.max("distance").alias("u"), F.count("*").alias("n")).collect()}
    near = _nearest(data.select("id", "v"), pivots, k + 1).collect()
    between = _distances(pivots.query, pivots.data)
    blocks = {g: -(-r.n // QUERIES_PER_BLOCK) for g, r in radius.items()}
    reach = {}
    for g, r in radius.items():
        upper: dict[int, float] = {}
        for s in near:
            upper[s.id] = min(upper.get(s.id, np.inf), r.u + between[g, s.cell] + s.distance)
        bounds = sorted(upper.values())
        reach[g] = r.u + (bounds[k] if k < len(bounds) else np.inf) + _slack(top)
    salts = -(-n_data // ROWS_PER_BLOCK)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_added(_matrix(batch.column(2), width), top), pivots.query)
            for g, within in reach.items():
                rows = batch.filter(pa.array(d[:, g] <= within))
                for b in range(blocks[g] if rows.num_rows else 0):
                    part = pa.array(np.full(rows.num_rows, g << 32 | b))
                    yield pa.RecordBatch.from_arrays([part, *rows.columns], ["part", "salt", "id", "v"])

    salted = data.select(F.pmod(F.xxhash64("id", "v", "copy"), F.lit(salts)).alias("salt"), "id", "v")
    sent = ready(salted).mapInArrow(replicate, "part long, salt long, id long, v array<bigint>")
    count = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))
    asked = queries.join(placed, "no").select(
        (F.shiftleft(F.col("cell"), 32) + F.pmod(F.xxhash64("no"), count[F.col("cell")])).alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"),
        "no",
        "id",
        "v",
    )

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        return _solved(left, right, width, k)

    best = (
        asked.groupBy("part", "salt")
        .cogroup(sent.groupBy("part", "salt"))
        .applyInArrow(solve, "no long, query_id long, id long, score long")
    )
    return _ranked(best, k)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), "id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "id", "score").where(F.col("rank") <= k)


def _solved(queries: pa.Table, data: pa.Table, width: int, k: int) -> pa.Table:
    """The k best of one block's rows for each of its queries."""
    queries, data = queries.combine_chunks(), data.combine_chunks()
    out: list[list] = [[], [], [], []]
    if queries.num_rows and data.num_rows:
        q = _matrix(queries["v"].chunk(0), width)
        x = _matrix(data["v"].chunk(0), width)
        ids = data["id"].to_numpy()
        exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width < _EXACT
        q, x = (q, x) if exact else (q.astype(np.int64), x.astype(np.int64))
        numbers, own = queries["no"].to_numpy(), queries["id"].to_numpy()
        for at in range(0, len(q), max(1, _CELLS // len(x))):
            part = slice(at, at + max(1, _CELLS // len(x)))
            scores = (q[part] @ x.T).astype(np.int64)
            other = ids != own[part, None]
            scores[~other] = np.iinfo(np.int64).min
            if len(ids) > k:
                other &= scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
            row, column = np.nonzero(other)
            order = np.lexsort((ids[column], -scores[row, column], row))
            row, column = row[order], column[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k  # ties go to the smaller id
            row, column = row[kept], column[kept]
            for values, found in zip(out, (numbers[part][row], own[part][row], ids[column], scores[row, column]), strict=True):
                values.append(found)
    if not out[0]:
        out = [[np.zeros(0, np.int64)]] * 4
    return pa.table([pa.array(np.concatenate(c)) for c in out], ["no", "query_id", "id", "score"])
