"""Embeddings and exact top-k search over a Parquet table of vectors.

Search never joins queries with vectors row by row. Queries come in loads of bounded size; a load is sent to all tasks,
a task multiplies it, block by block, with the vectors it reads and keeps its own k best of every query, and only those
meet in the shuffle. The larger side is read in place, once for each load; with more than one, each writes its hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.commits import CommitLog, Snapshot
from contextloom.schema import INDEX
from contextloom.storage import cut, scratch

QUERY_BLOCK, TILE = 1024, 1024  # queries and vectors that are multiplied at a time
LOAD_BYTES = 32 << 20  # of queries and their hits, for a scan
Load = tuple[np.ndarray, np.ndarray]  # ids and vectors of queries


def normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scorable(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of the vectors that have ``dim`` elements, all of them finite numbers."""
    fits = pc.equal(pc.list_value_length(vectors), dim)
    if not pc.all(fits).as_py():
        ids, vectors = ids.filter(fits), vectors.filter(fits)
    m = matrix(vectors).reshape(len(vectors), dim)
    finite = np.isfinite(m).all(1)
    return (ids.to_numpy(), m) if finite.all() else (ids.to_numpy()[finite], m[finite])


def tiles(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``scorable`` of (id, vector) batches by at most ``TILE`` rows, those without any left out: scores of a tile are few however large batches are."""
    for batch in batches:
        for start in range(0, len(batch), TILE):
            part = batch.slice(start, TILE)
            ids, m = scorable(part.column(0), part.column(1), dim)
            if len(ids):
                yield ids, m


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=m.copy(), where=norm > 0)


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first; equal scores go by id. ``ids`` has the shape of ``scores``."""
    least = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]
    row, at = np.nonzero(scores >= least[:, None])  # all that is at least as good as the k-th
    s, d = scores[row, at], ids[row, at]
    order = np.lexsort((d, -s, row))
    first = np.searchsorted(row, np.arange(len(scores)))
    picked = order[(first[:, None] + np.arange(k)).ravel()]
    return s[picked].reshape(-1, k), d[picked].reshape(-1, k)


def query_loads(queries: DataFrame, query_id: str, vector: str, k: int, load_bytes: int) -> Iterator[Load]:
    """Ids and vectors of as many queries as ``load_bytes`` hold, with k hits of each; those of one load have one dimension."""
    loads: dict[int, tuple[list[int], list[list[float]]]] = {}
    held = 0
    for r in queries.select(F.col(query_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null").toLocalIterator():
        if not np.isfinite(np.array(r.v, np.float64)).all():
            continue
        if held and held + 8 * len(r.v) + 32 * k > load_bytes:
            yield from ((np.array(ids), np.array(rows)) for ids, rows in loads.values())
            loads, held = {}, 0
        held += 8 * len(r.v) + 32 * k
        ids, rows = loads.setdefault(len(r.v), ([], []))
        ids.append(r.i)
        rows.append(r.v)
    yield from ((np.array(ids), np.array(rows)) for ids, rows in loads.values())


def blocked_scan(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, digits: int | None, block: int) -> DataFrame:
    """Each task's k best of every query, by matrix products of blocks of queries with batches of vectors."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_ids = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)
        for ids, m in tiles(batches, q.shape[1]):
            m = unit_rows(m).T
            for start in range(0, len(q_ids), block):
                part = slice(start, start + block)
                scores = q[part] @ m
                if digits is not None:
                    scores = np.round(scores, digits) + 0.0
                both = np.concatenate((kept[part], scores), 1), np.concatenate((kept_ids[part], np.broadcast_to(ids, scores.shape)), 1)
                kept[part], kept_ids[part] = best_of_rows(*both, k)
        real = kept > -np.inf
        yield pa.record_batch({"query_id": np.repeat(q_ids, real.sum(1)), "id": kept_ids[real], "score": kept[real]})

    return rows.mapInArrow(scan, "query_id long, id long, score double")


def native_scan(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, digits: int | None, block: int) -> DataFrame:
    """The same in column expressions, for sessions without Python workers: one scan, in which each vector meets the load's queries.

    The load is one row, an array of queries, which goes to the vectors by broadcast. A task's window keeps its k best of a
    query before anything shuffles.
    """
    asked = rows.sparkSession.createDataFrame([([(int(i), v.tolist()) for i, v in zip(q_ids, q, strict=True)],)], "asked array<struct<query_id:long,w:array<double>>>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    unit = rows.where((F.size("v") == q.shape[1]) & ~odd).select("id", normalised(F.col("v")).alias("v"))
    met = unit.crossJoin(F.broadcast(asked)).select("id", "v", F.explode("asked").alias("x"))
    score = F.aggregate(F.zip_with("v", F.col("x.w"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = met.select(F.col("x.query_id").alias("query_id"), "id", score.alias("score"))
    return out.withColumn("score", F.round("score", digits) + F.lit(0.0)) if digits is not None else out


def normalizer_scan(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, scale: float, block: int) -> DataFrame:
    """Each task's (query_id, top, total): its best score of a query, and the sum of exp(scale * (score - top)) over all its vectors."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, total = np.full(len(q_ids), -np.inf), np.zeros(len(q_ids))
        for ids, m in tiles(batches, q.shape[1]):
            m = unit_rows(m).T
            for start in range(0, len(q_ids), block):
                part = slice(start, start + block)
                scores = q[part] @ m
                best = np.maximum(top[part], scores.max(1))
                total[part] = total[part] * np.exp(scale * (top[part] - best)) + np.exp(scale * (scores - best[:, None])).sum(1)
                top[part] = best
        some = total > 0
        yield pa.record_batch({"query_id": q_ids[some], "top": top[some], "total": total[some]})

    return rows.mapInArrow(scan, "query_id long, top double, total double")


STRATEGIES = {"blocked": blocked_scan, "native": native_scan}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "id", vector: str = "embedding", query_id: str = "query_id",
          query_vector: str = "embedding", digits: int | None = None, least: float | None = None, block: int = QUERY_BLOCK,
          strategy: str = "blocked", load_bytes: int = LOAD_BYTES) -> DataFrame:
    """The k nearest vectors of each query by cosine: query_id, id, score, rank (from 1; equal scores by id).

    ``digits`` rounds scores before they are ranked; ``least`` drops hits below it. Fewer than k vectors give fewer hits.
    A vector that has a null, NaN or infinite element is no hit, and one of another dimension than the query's neither; a query
    of that kind has no hits. Zero vectors score 0. ``strategy``: matrix products in Arrow batches (``blocked``) or column expressions (``native``).
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

    def hits(load: Load) -> DataFrame:
        found = STRATEGIES[strategy](rows, load[0], unit_rows(load[1]), k, digits, block)
        if least is not None:
            found = found.where(F.col("score") >= least)
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    loads = query_loads(queries, query_id, query_vector, k, load_bytes)
    return joined_loads(loads, hits, vectors.sparkSession, "query_id long, id long, score double, rank int")


def joined_loads(loads: Iterator[Load], hits: Callable[[Load], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """The hits of all loads; with more than one, each writes its own before the next one is read."""
    first, second = next(loads, None), next(loads, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return hits(first)
    out = cut(hits(first)).unionByName(cut(hits(second)))
    for load in loads:
        out = out.unionByName(cut(hits(load)))
    return out


def softmax_top(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "id", vector: str = "embedding", query_id: str = "query_id",
                query_vector: str = "embedding", scale: float = 100.0, block: int = QUERY_BLOCK, load_bytes: int = LOAD_BYTES) -> DataFrame:
    """The k likeliest vectors of each query: query_id, id, score, rank, p, the softmax of the scaled scores over all vectors.

    However many vectors there are, a task sends k hits and two numbers of each query.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

    def hits(load: Load) -> DataFrame:
        q = unit_rows(load[1])
        parts = normalizer_scan(rows, load[0], q, scale, block)
        top = parts.groupBy("query_id").agg(F.max("top").alias("most"))
        total = parts.join(top, "query_id").groupBy("query_id", "most").agg(F.sum(F.col("total") * F.exp(scale * (F.col("top") - F.col("most")))).alias("total"))
        best = blocked_scan(rows, load[0], q, k, None, block).withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(total, "query_id").select("query_id", "id", "score", "rank", (F.exp(scale * (F.col("score") - F.col("most"))) / F.col("total")).alias("p"))

    loads = query_loads(queries, query_id, query_vector, k, load_bytes)
    return joined_loads(loads, hits, vectors.sparkSession, "query_id long, id long, score double, rank int, p double")


# ---- hashing embedder ----
class BucketOf(dict):
    """Word -> bucket: the first 28 bits of its md5 modulo the dimension."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % self.dim
        return value


def hash_embedded(rows: DataFrame, key: str, text: str, dim: int = 256, out: str = "embedding") -> DataFrame:
    """(key, embedding): counts of the words of a text by hash bucket; blank texts give a zero vector."""
    picked = rows.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = dict(picked.dtypes)["key"]

    def embed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = BucketOf(dim)
        for batch in batches:
            m = np.zeros((len(batch), dim), np.float32)
            for i, t in enumerate(batch.column(1).to_pylist()):
                at = [bucket[w] for w in ascii_words(t)]
                if at:
                    m[i] = np.bincount(at, minlength=dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", out])

    return picked.mapInArrow(embed, f"key {kind}, {out} array<float>").withColumnRenamed("key", key)


def ascii_words(text: str) -> list[str]:
    """Words between ASCII white space."""
    return [w for w in text.translate(ASCII_SPACE).split(" ") if w]


ASCII_SPACE = dict.fromkeys(range(9, 14), " ")


class VectorIndex:
    """An append-only table of vectors with dense ids, and a manifest of its dimension, model and count.

    Each insert is one commit (``commits.CommitLog``): rows and manifest become visible together or not at all, writers that
    insert at the same time get ids one after the other, and a search reads the state it began with. ``dedup`` leaves out
    chunks whose chunk_id the table has already, and repeats within a call. Vectors of another dimension, or of a model other than the
    manifest's, are refused before anything is committed.
    """

    def __init__(self, spark: SparkSession, path: str, model: str | None = None):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.log = CommitLog(spark, self.path)

    def exists(self) -> bool:
        return self.log.latest().number > 0

    def load(self, state: Snapshot | None = None) -> DataFrame:
        """The rows now, or after a commit."""
        return self.log.rows(state or self.log.latest(), INDEX)

    def manifest(self, state: Snapshot | None = None) -> Manifest:
        meta = (state or self.log.latest()).meta
        return Manifest(meta.get("dimension"), meta.get("model"), meta.get("count", 0))

    def insert(self, chunks: DataFrame, dedup: bool = False) -> int:
        """Append chunks (text, meta, chunk_id, source, embedding), blank texts left out; the number of new rows."""
        chunks = chunks.where(F.col("text").rlike(r"(?U)\S"))
        if dedup:
            chunks = chunks.dropDuplicates(["chunk_id"])
        columns = [f.split()[0] for f in ("id", "embedding", "text", "meta", "chunk_id", "source", "added_at")]
        added = 0

        def attempt(base: Snapshot) -> tuple[tuple[tuple[str, int], ...], dict] | None:
            nonlocal added
            fresh = chunks.join(self.load(base).select("chunk_id"), "chunk_id", "left_anti") if dedup else chunks
            known = self.manifest(base)
            rows = with_index_ids(fresh, known.count)  # written, so that what is counted is what is appended
            new = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
            if new.n and {new.lo, new.hi} != {known.dimension or new.lo}:
                raise ValueError(f"vectors of {new.lo} to {new.hi} dimensions for an index of {known.dimension or new.lo}")
            if self.model and known.model and self.model != known.model:
                raise ValueError(f"vectors of {self.model} for an index of {known.model}")
            added = new.n
            if not added:
                return None
            name = self.log.write(rows.withColumn("added_at", F.current_timestamp()).select(*columns))
            return (*base.folders, (name, base.number + 1)), {"dimension": known.dimension or new.lo, "model": known.model or self.model, "count": known.count + new.n}

        with scratch(self.spark):
            self.log.transact(attempt)
        return added

    def next_id(self) -> int:
        return self.manifest().count

    def search(self, queries: DataFrame, k: int = 10, **options: object) -> DataFrame:
        """Hits with text and metadata, which are looked up for the hits only."""
        have = self.load()
        hits = top_k(have, queries, k, **options)  # type: ignore[arg-type]
        return hits.join(have.select("id", "text", "meta", "source"), "id")

    def stats(self) -> DataFrame:
        return index_stats(self.load())

    def clear(self) -> None:
        """An empty index; what older readers have open stays until ``log.vacuum``."""
        self.log.transact(lambda base: ((), {"dimension": None, "model": None, "count": 0}))

    def export(self, path: str) -> VectorIndex:
        """A copy of the rows and the manifest of one state at another path, in place of what is there."""
        copy, state = VectorIndex(self.spark, path, self.model), self.log.latest()
        name = copy.log.write(self.load(state))
        copy.log.transact(lambda base: (((name, base.number + 1),), state.meta))
        return copy

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> VectorIndex:
        """The index saved at ``path``; an error if there is none or its rows aren't those of its manifest."""
        index = cls(spark, path)
        state = index.log.latest()
        if not state.number:
            raise FileNotFoundError(path)
        m = index.manifest(state)
        have = index.load(state).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        if (have.n, have.d) != (m.count, m.dimension if m.count else None):
            raise ValueError(f"{path} has {have.n} rows of {have.d} dimensions, its manifest {m.count} of {m.dimension}")
        index.model = m.model
        return index


@dataclass(frozen=True)
class Manifest:
    dimension: int | None
    model: str | None
    count: int


def with_index_ids(rows: DataFrame, base: int = 0, order: str = "chunk_id", id_column: str = "id") -> DataFrame:
    """Dense ids from ``base`` in the order of a column, without bringing all rows into one task.

    Rows are range-partitioned and sorted, and written once with their partition and their place in it. Counts and ids
    both come from that one table, so they agree however partitions are merged or retried; rows of one key may lie in
    several partitions. Only a count for each partition meets in one task.
    """
    chance, at = "_chance", F.monotonically_increasing_id()  # partition << 33 | place
    placed = rows.withColumn(chance, F.monotonically_increasing_id()).repartitionByRange(F.col(order), F.col(chance)).sortWithinPartitions(order, chance)
    placed = cut(placed.withColumn("_at", at).drop(chance)).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before + base).alias("_first"))  # a row for each partition
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn(id_column, (F.col("_first") + place).cast("long")).drop("_part", "_first", "_at")


def index_stats(index: DataFrame, vector: str = "embedding", key: str = "id") -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total"), F.max(F.size(vector)).alias("dimension"), F.count(key).alias("metadata_count"))
