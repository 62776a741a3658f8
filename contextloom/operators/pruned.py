"""Exact search that leaves out vectors which cannot be among the k nearest.

Vectors are gathered in cells around centers, and each cell knows the widest angle between its center and its vectors. By the
triangle inequality on the sphere no vector of a cell is nearer to a query than the angle to the center less that radius. A
first scan of the likeliest cells gives each query a k-th score; a second one reads just the cells whose bound reaches it,
and compares a cell with those queries only. Centers come from a bounded sample; they decide how much is left out, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.operators.vectors import LOAD_BYTES, QUERY_BLOCK, Load, best_of_rows, joined_loads, matrix, query_loads, scorable, unit_rows
from contextloom.storage import cut

SAMPLE, MOST_CELLS, STEPS = 20_000, 4096, 6
ZERO = -1  # the cell of zero vectors, whose score is 0 with every query
ROUNDING = 1e-7  # of angles and scores


def centers_of(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centers by some steps of spherical k-means."""
    r = np.random.default_rng(seed)
    centers = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(STEPS):
        near = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        some = np.bincount(near, minlength=len(centers)) > 0
        centers = np.where(some[:, None], unit_rows(sums), centers)
    return centers


@dataclass(frozen=True)
class Cells:
    """A table of vectors (cell, id, v) sorted by cell, its centers, and for each cell how many vectors it has and their widest angle."""

    rows: DataFrame
    centers: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    zeros: int

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each unit query and cell, the best score that one of its vectors can have; the last column is that of zero vectors."""
        angle = np.arccos(np.clip(q @ self.centers.T, -1, 1))
        best = np.cos(np.maximum(0, angle - self.radius)) + ROUNDING
        best[:, self.sizes == 0] = -np.inf
        return np.c_[best, np.full(len(q), ROUNDING if self.zeros else -np.inf)]


def celled(vectors: DataFrame, id_column: str = "id", vector: str = "embedding", cells: int | None = None) -> Cells:
    """The vectors by cells, written. They have one dimension; rows without id, and vectors with odd elements, are left out.

    Without ``cells`` there are about as many as the square root of the rows, ``MOST_CELLS`` at most.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if told.n and told.lo != told.hi:
        raise ValueError(f"vectors of {told.lo} to {told.hi} dimensions")
    some = rows.sample(min(1.0, 2 * SAMPLE / told.n), 5).limit(SAMPLE).collect() if told.n else []  # at most SAMPLE vectors
    sample = np.array([r.v for r in some if r.v and all(x is not None for x in r.v)], np.float64).reshape(-1, told.hi or 1)
    sample = unit_rows(sample[np.isfinite(sample).all(1) & sample.any(1)])
    wanted = cells or min(MOST_CELLS, max(1, round(told.n**0.5)))
    centers = centers_of(sample, wanted) if len(sample) else np.zeros((1, told.hi or 1))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = scorable(batch.column(0), batch.column(1), centers.shape[1])
            m = unit_rows(m)
            near = m @ centers.T
            cell = near.argmax(1) if len(m) else np.zeros(0, np.int64)
            cell = np.where(m.any(1), cell, ZERO)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * centers.shape[1]), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(ids, pa.int64()), lists, pa.array(near[np.arange(len(m)), np.maximum(cell, 0)], pa.float64())], names=["cell", "id", "v", "close"])

    placed = cut(rows.mapInArrow(place, "cell int, id long, v array<double>, close double").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
    sizes, radius = np.zeros(len(centers), np.int64), np.zeros(len(centers))
    zeros = 0
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("close").alias("close")).collect():  # a row for each cell
        if r.cell == ZERO:
            zeros = r.n
        else:
            sizes[r.cell], radius[r.cell] = r.n, np.arccos(np.clip(r.close, -1, 1)) + ROUNDING
    return Cells(placed.select("cell", "id", "v"), centers, sizes, radius, zeros)


def cell_scan(cells: Cells, q_ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, digits: int | None) -> DataFrame:
    """Each task's k best of every query, from the cells that are ``wanted`` for it (queries x cells, zero vectors last)."""
    chosen = [int(c) if c < len(cells.centers) else ZERO for c in np.flatnonzero(wanted.any(0))]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_ids = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            cell, ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for c in np.unique(cell):
                at = cell == c
                who = np.flatnonzero(wanted[:, c])  # ZERO is the last column
                for start in range(0, len(who), QUERY_BLOCK):
                    part = who[start : start + QUERY_BLOCK]
                    scores = q[part] @ m[at].T
                    if digits is not None:
                        scores = np.round(scores, digits) + 0.0
                    both = np.concatenate((kept[part], scores), 1), np.concatenate((kept_ids[part], np.broadcast_to(ids[at], scores.shape)), 1)
                    kept[part], kept_ids[part] = best_of_rows(*both, k)
        real = kept > -np.inf
        yield pa.record_batch({"query_id": np.repeat(q_ids, real.sum(1)), "id": kept_ids[real], "score": kept[real]})

    return cells.rows.where(F.col("cell").isin(chosen)).mapInArrow(scan, "query_id long, id long, score double")


def likeliest(cells: Cells, bounds: np.ndarray, k: int) -> np.ndarray:
    """For each query the cells of the best bounds that together have k vectors."""
    sizes = np.r_[cells.sizes, cells.zeros]
    order = np.argsort(-bounds, 1, kind="stable")
    before = np.cumsum(sizes[order], 1) - sizes[order]
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, before < k, 1)
    return out & (sizes > 0)


def pruned_top_k(cells: Cells, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_vector: str = "embedding", digits: int | None = None,
                 least: float | None = None, load_bytes: int = LOAD_BYTES, skipped: list[float] | None = None) -> DataFrame:
    """The same hits as ``vectors.top_k``: query_id, id, score, rank. ``skipped`` is told the share of comparisons left out, by load.

    As there, scores of equal vectors may differ in the last bit unless ``digits`` rounds them.
    """
    spark = cells.rows.sparkSession
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    slack = ROUNDING + (10.0**-digits if digits is not None else 0.0)
    sizes = np.r_[cells.sizes, cells.zeros]

    def best(scan: DataFrame) -> DataFrame:
        return scan.withColumn("rank", rank).where(F.col("rank") <= k)

    def hits(load: Load) -> DataFrame:
        ids, q = load[0], unit_rows(load[1])
        if q.shape[1] != cells.centers.shape[1]:
            return spark.createDataFrame([], "query_id long, id long, score double, rank int")
        bounds = cells.bounds(q)
        bounds[~q.any(1)] = np.where(sizes > 0, 1.0, -np.inf)  # a zero query is as far from all
        first = likeliest(cells, bounds, k)
        place = np.arange(len(ids))  # repeated ids are told apart
        found = best(cell_scan(cells, place, q, first, k, digits)).where(F.col("rank") == k).select("query_id", "score").collect()  # a number for each query
        reached = np.full(len(ids), -np.inf)
        for r in found:
            reached[r.query_id] = r.score
        wanted = (bounds >= reached[:, None] - slack) & (sizes > 0)
        if skipped is not None:
            skipped.append(1 - float((wanted * sizes).sum()) / max(1.0, float(len(ids) * sizes.sum())))
        if least is not None:
            wanted &= bounds >= least - slack
        out = best(cell_scan(cells, place, q, wanted, k, digits))
        named = spark.createDataFrame([(int(i), int(n)) for i, n in zip(place, ids, strict=True)], "query_id long, name long")
        out = out.join(F.broadcast(named), "query_id").select(F.col("name").alias("query_id"), "id", "score", "rank")
        return out if least is None else out.where(F.col("score") >= least)

    return joined_loads(query_loads(queries, query_id, query_vector, k, load_bytes), hits, spark, "query_id long, id long, score double, rank int")
