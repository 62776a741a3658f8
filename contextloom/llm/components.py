"""Connected components of links, on DataFrames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.common import cut, release, ship

HOT_ROWS, MAX_HOT = 1000, 10_000
FEW_NODES, FOREST = 1 << 18, 1 << 18  # smallest neighbours of so many nodes, 16 bytes each, go by broadcast; edges that a task holds at once


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to the one row that ``groups`` has for their ``key``.

    Groups with more than one row in ``MAX_HOT`` can't be more than ``MAX_HOT``: they go to the rows by broadcast,
    so no task takes in a large group. ``groups`` is used twice and should be a written table.
    """
    hot_size = max(HOT_ROWS, n_rows // MAX_HOT)
    hot = F.broadcast(groups.where(F.col(size) > hot_size))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(F.col(size) <= hot_size), key, how))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node that each of them reaches by these alone, which is left out itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := top[x] != top[y]).any():
        x, y = x[apart], y[apart]
        tx, ty = top[x], top[y]
        np.minimum.at(top, np.maximum(tx, ty), np.minimum(tx, ty))
        while ((up := top[top]) != top).any():
            top = up
    below = top < np.arange(len(nodes))
    return nodes[below], nodes[top[below]]


def forests(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) as stars that link the same nodes, of ``FOREST`` edges at a time; nothing shuffles."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) >= FOREST):
                a, b = forest(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
                yield pa.record_batch({"a": a, "b": b})
                held = []

    return edges.mapInArrow(stars, "a long, b long")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. ``links`` has long columns a and b.

    Large-star and small-star steps, after each of which the tasks make forests of what they hold: each round hangs the
    neighbours of a node on the smallest of them, until every component is a star. The edges are written to the shared
    folder each round, in place of the last ones; only two counts reach the driver. While there are at most
    ``FEW_NODES``, the smallest neighbours go to the edges by broadcast; of more, nodes with very many edges meet
    theirs in joins that adaptive execution can split.
    Loops, repeated links and an empty table are fine; rows with a null are left out.
    """
    ship(links.sparkSession)
    edges = cut(forests(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(max_rounds):
        nodes, unsettled = _state(edges)
        if not unsettled:
            break
        old, edges = edges, cut(forests(_hung(edges, nodes <= FEW_NODES)))
        release(old)
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    return edges.select(F.inline(F.expr("array(named_struct('node', a, 'component', b), named_struct('node', b, 'component', b))"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many nodes there are, and how many of them have two smaller neighbours or a smaller and a larger one."""
    ends = F.expr("array(named_struct('u', a, 'less', b, 'more', 0), named_struct('u', b, 'less', cast(null as long), 'more', 1))")
    around = edges.select(F.inline(ends)).groupBy("u").agg(F.min("less").alias("lo"), F.max("less").alias("hi"), F.max("more").alias("more"))
    found = around.agg(F.count(F.lit(1)), F.count_if(F.expr("lo <> hi or (lo is not null and more = 1)"))).first()
    return found[0], found[1]


def _hung(edges: DataFrame, few: bool) -> DataFrame:
    """A large and a small star; edges (a, b) have a > b, and some come more than once."""
    to_all = F.broadcast if few else (lambda df: df)
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"))
    large = edges.join(to_all(least(edges).withColumnRenamed("a", "b")), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    hung = large.join(to_all(least(large)), "a")
    return hung.select(F.inline(F.expr("array(named_struct('a', a, 'b', m), named_struct('a', b, 'b', m))"))).where("a <> b")
