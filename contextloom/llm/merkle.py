"""Merkle manifest of a dataset: one root for all rows, a subroot for each group, a proof for each row.

A leaf is the SHA-256 of a row's columns. Leaves of a group, in order of their key, are hashed in runs of ``ARITY`` until one
node remains, the subroot; the subroots, in order of their group, give the root the same way.

Sparse forests. Leaves are sorted over range partitions and written with their place. A partition then holds a stretch
of leaves of one or more trees; it hashes every sibling run that it has whole, and what it can't finish is its forest: nodes
keyed by tree, level and index, at most ``ARITY`` - 1 at either end of each level of its first and last tree and of the tree of
subroots. Forests join associatively (``joined``): the union of the nodes, in which a run turns into its parent once it is
complete. How long a run is follows from the tree's size, which is counted beforehand. ``tree_reduce`` joins ``FAN_IN``
neighbouring forests to one, round after round, until one is left, which is the root. Its rounds are written tables, so a lost
executor costs a round at most, and nodes that were completed at a seam between partitions stay there for the proofs.

Proofs. A partition needs from elsewhere only siblings on the paths of its first and last leaves. Their keys are joined with
the nodes of the forests, and the few that each partition needs come to its leaves; everything else it hashes again. A task
holds the digests of one partition, which has about ``ROWS`` rows. A row for each partition is all that reaches the driver.

Defined cases: a null column is a leaf's ``-``; a null group comes first and is a group; null keys come first in their group;
rows with equal group and key are ordered by their leaf, and fully equal rows are leaves of their own; a group of one row has its
leaf as subroot, and one group's subroot is the root; an empty table has no root and gives an empty result; columns that aren't
named don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.llm.common import cut, quoted, scratch, ship

ARITY, FAN_IN, ROWS = 16, 16, 250_000
TOP = -1  # number of the tree of subroots; the groups' trees count from 0
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE_BITS = 33  # of monotonically_increasing_id
Key = tuple[int, int, int]  # tree, level, index
NODES = "part long, tree long, level int, idx long, n long, digest binary, made boolean, open boolean"


def leaf(columns: Sequence[Column]) -> Column:
    """Hex digest of the columns: ``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def node(children: Sequence[bytes]) -> bytes:
    """Digest of a run; digests are hex text in bytes."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


# ---- forests ----
def level_sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, from the leaves to the one that remains."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def stretches(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """On each level of a tree of n leaves the nodes [from, to) that hang on nothing but the leaves [lo, hi)."""
    out = [(lo, hi)]
    for size in level_sizes(n)[:-1]:
        first = -(-lo // ARITY)
        last = -(-size // ARITY) if hi == size else hi // ARITY
        lo, hi = first, max(first, last)
        out.append((lo, hi))
    return out


def climbed(lo: int, leaves: list[bytes], n: int) -> list[tuple[int, list[bytes]]]:
    """On each level the first index and the digests of the nodes that these leaves give."""
    sizes, out = level_sizes(n), [(lo, leaves)]
    for level, (a, b) in enumerate(stretches(lo, lo + len(leaves), n)[1:], 1):
        start, below = out[-1]
        out.append((a, [node(below[p * ARITY - start : min((p + 1) * ARITY, sizes[level - 1]) - start]) for p in range(a, b)]))
    return out


def unfinished(tree: int, levels: list[tuple[int, list[bytes]]]) -> dict[Key, bytes]:
    """The nodes of ``levels`` whose parent isn't there; of a finished tree that is its top."""
    out: dict[Key, bytes] = {}
    for level, (start, digests) in enumerate(levels):
        up, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        out |= {(tree, level, start + i): d for i, d in enumerate(digests) if not up <= (start + i) // ARITY < up + len(above) or level + 1 == len(levels)}
    return out


def joined(nodes: dict[Key, bytes], more: dict[Key, bytes], sizes: dict[int, int]) -> tuple[dict[Key, bytes], dict[Key, bytes]]:
    """The union of two forests in which complete runs have become their parents, and the parents made.

    ``sizes`` has the leaves of each tree, of ``TOP`` the number of trees. The top of a group's tree is a leaf of ``TOP``.
    """
    open_, made = dict(nodes), {}
    todo = list(more.items())
    while todo:
        key, digest = todo.pop()
        open_[key] = digest
        tree, level, index = key
        counts = level_sizes(sizes[tree])
        if level + 1 == len(counts):
            if tree != TOP:
                del open_[key]
                todo.append(((TOP, 0, tree), digest))
                made[TOP, 0, tree] = digest
            continue
        run = [(tree, level, i) for i in range(index // ARITY * ARITY, min((index // ARITY + 1) * ARITY, counts[level]))]
        if all(k in open_ for k in run):
            parent = (tree, level + 1, index // ARITY)
            made[parent] = node([open_.pop(k) for k in run])
            todo.append((parent, made[parent]))
    return open_, made


class Share(NamedTuple):
    """What a partition must know: number and place of its first tree, sizes of its first and last tree, its trees, all trees."""

    part: int
    tree: int
    base: int
    first_n: int
    last_n: int
    trees: int
    all_trees: int
    first_here: int
    last_here: int

    def local_trees(self) -> tuple[int, int]:
        """Trees [from, to) whose leaves all lie here."""
        first = self.base == 0 and self.first_here == self.first_n
        last = self.last_here == self.last_n and (first or self.trees > 1)
        return (self.tree, self.tree + int(first)) if self.trees == 1 else (self.tree + int(not first), self.tree + self.trees - int(not last))


def shares(parts: list[Any]) -> list[Share]:
    """From rows (part, k, first, last) in order of part; first and last are (place, group, n) of its outer groups."""
    found: list[tuple[int, int, int, int, int, int]] = []
    total: dict[int, int] = {}
    tree, group, held = -1, None, 0
    for r in parts:
        if tree >= 0 and r.first["by"] == group:
            base = held
        else:
            tree, base = tree + 1, 0
        total[tree] = base + r.first["n"]
        found.append((r.part, tree, base, r.k, r.first["n"], r.last["n"]))
        if r.k > 1:
            tree += r.k - 1
            total[tree] = r.last["n"]
        group, held = r.last["by"], total[tree]
    return [Share(p, t, b, total[t], total[t + k - 1], k, tree + 1, f, z) for p, t, b, k, f, z in found]


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each partition together; they come in order of part."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = [0, *(i + 1 for i in (parts[1:] != parts[:-1]).nonzero()[0].tolist()), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and parts[a] != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = parts[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Stretch:
    """The leaves of a partition: its share, and the levels of its trees and of the tree of subroots as far as they hang on them."""

    def __init__(self, share: Share, digests: list[bytes], groups: list[bytes]):
        starts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1])]
        self.share, self.starts = share, starts
        self.sizes = {TOP: share.all_trees}
        self.levels: dict[int, list[tuple[int, list[bytes]]]] = {}
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(digests)], strict=True)):
            tree = share.tree + k
            n = share.first_n if k == 0 else share.last_n if k == share.trees - 1 else b - a
            self.sizes[tree] = n
            self.levels[tree] = climbed(share.base if k == 0 else 0, digests[a:b], n)
        lo, hi = share.local_trees()
        self.levels[TOP] = climbed(lo, [self.levels[t][-1][1][0] for t in range(lo, hi)], share.all_trees)

    def forest(self) -> dict[Key, bytes]:
        out = unfinished(TOP, self.levels[TOP])
        lo, hi = self.share.local_trees()
        for tree, levels in self.levels.items():
            if tree != TOP and not lo <= tree < hi:
                out |= unfinished(tree, levels)
        return out


def outside(share: Share) -> Iterator[Key]:
    """Keys of the nodes on the paths of a partition's leaves, their siblings included, that don't hang on its leaves alone."""
    lo, hi = share.local_trees()
    last = share.tree + share.trees - 1
    wanted = [(TOP, share.all_trees, share.tree, last + 1, lo, hi), (share.tree, share.first_n, share.base, share.base + share.first_here, share.base, share.base + share.first_here)]
    if share.trees > 1:
        wanted.append((last, share.last_n, 0, share.last_here, 0, share.last_here))
    for tree, n, a, b, own_lo, own_hi in wanted:
        sizes, own = level_sizes(n), stretches(own_lo, own_hi, n)
        for level, size in enumerate(sizes[:-1]):
            b = b - 1
            ends = range(a // ARITY * ARITY, min((b // ARITY + 1) * ARITY, size))
            here = range(max(own[level][0], ends.start), max(own[level][0], ends.start, min(own[level][1], ends.stop)))
            for i in (*range(ends.start, here.start), *range(here.stop, ends.stop)) if here else ends:
                yield tree, level, i
            a, b = a // ARITY, b // ARITY + 1


# ---- tables ----
def sorted_leaves(docs: DataFrame, columns: Sequence[str], by: str, key: str, claimed: dict[str, Column]) -> DataFrame:
    """part, place, key, digest, claim, by: all leaves in order of group and key, written.

    ``claim`` is the leaf of the row with the columns of ``claimed`` in place of its own, null where that is the same.
    """
    own = quoted(columns)
    other = leaf([claimed.get(c, x) for c, x in zip(columns, own, strict=True)]) if claimed else F.lit(None)
    found = docs.select(quoted([by])[0].alias("by"), quoted([key])[0].alias("key"), leaf(own).alias("digest"), other.alias("claim"))
    found = cut(found.select("by", "key", F.unhex("digest").alias("digest"), F.unhex(F.when(F.col("claim") != F.col("digest"), F.col("claim"))).alias("claim")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // ROWS))  # type: ignore[arg-type]
    order = ("by", "key", "digest")
    placed = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    group = F.coalesce(F.unhex(F.md5(F.col("by").cast("string"))), F.lit(b"")).alias("by")
    return cut(placed.select(F.shiftright(at, PLACE_BITS).alias("part"), at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"), "key", "digest", "claim", group))


def shares_of(leaves: DataFrame) -> list[Share]:
    groups = leaves.groupBy("part", "by").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    outer = F.struct("place", "by", "n")
    parts = groups.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.min(outer).alias("first"), F.max(outer).alias("last"))
    return shares(parts.orderBy("part").collect())  # a row for each partition


def forests(leaves: DataFrame, told: DataFrame, n_parts: int) -> DataFrame:
    """The forest of each partition as rows (``NODES``), with all subroots that it finished. Written."""
    first = leaves.select("part", "place", "digest", "by", F.lit(None).cast("array<long>").alias("share"))
    heads = told.select("part", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("by"), "share")
    ready = first.unionByName(heads).repartition(n_parts, "part").sortWithinPartitions("part", "place")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            share = Share(*t.column("share")[0].as_py())
            stretch = Stretch(share, [d.hex().encode() for d in t.column("digest").to_pylist()[1:]], t.column("by").to_pylist()[1:])
            open_ = stretch.forest()
            lo, subroots = stretch.levels[TOP][0]
            done = {(TOP, 0, lo + i): d for i, d in enumerate(subroots) if (TOP, 0, lo + i) not in open_}
            yield node_rows(share.part, open_ | done, stretch.sizes, set(open_), set(open_) | set(done))

    return cut(ready.mapInArrow(start, NODES))


def node_rows(part: int, nodes: dict[Key, bytes], sizes: dict[int, int], open_: set[Key], made: set[Key]) -> pa.RecordBatch:
    keys = list(nodes)
    return pa.record_batch({
        "part": pa.array([part] * len(keys), pa.int64()), "tree": pa.array([k[0] for k in keys], pa.int64()), "level": pa.array([k[1] for k in keys], pa.int32()),
        "idx": pa.array([k[2] for k in keys], pa.int64()), "n": pa.array([sizes[k[0]] for k in keys], pa.int64()),
        "digest": pa.array([bytes.fromhex(nodes[k].decode()) for k in keys], pa.binary()), "made": pa.array([k in made for k in keys], pa.bool_()), "open": pa.array([k in open_ for k in keys], pa.bool_()),
    })


def tree_reduce(first: DataFrame, n_parts: int, all_trees: int) -> list[DataFrame]:
    """The rounds in which neighbouring forests are joined, ``first`` included; the last one's open node is the root."""
    rounds, left = [first], n_parts

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            part = t.column("part")[0].as_py()
            rows = zip(*(t.column(c).to_pylist() for c in ("of", "tree", "level", "idx", "n", "digest")), strict=True)
            held: dict[int, dict[Key, bytes]] = {}
            sizes = {TOP: all_trees}
            for of, tree, level, idx, n, digest in rows:
                held.setdefault(of, {})[tree, level, idx] = digest.hex().encode()
                sizes[tree] = n
            open_: dict[Key, bytes] = {}
            made: dict[Key, bytes] = {}
            for of in sorted(held):
                open_, more = joined(open_, held[of], sizes)
                made |= more
            yield node_rows(part, made | open_, sizes, set(open_), set(made))

    while left > 1:
        left = -(-left // FAN_IN)
        was = rounds[-1].where("open").select(F.floor(F.col("part") / FAN_IN).cast("long").alias("part"), F.col("part").alias("of"), "tree", "level", "idx", "n", "digest")
        rounds.append(cut(was.repartition(left, "part").sortWithinPartitions("part", "of").mapInArrow(merge, NODES)))
    return rounds


def paths_from_outside(nodes: DataFrame, told: DataFrame) -> DataFrame:
    """(part, tree, level, idx, digest): the nodes of other partitions that each partition's proofs need."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, share in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(outside(Share(*share)))
                yield pa.record_batch({
                    "part": pa.array([part] * len(rows), pa.int64()), "tree": pa.array([k[0] for k in rows], pa.int64()),
                    "level": pa.array([k[1] for k in rows], pa.int32()), "idx": pa.array([k[2] for k in rows], pa.int64()),
                })

    needed = told.select("part", "share").mapInArrow(keys, "part long, tree long, level int, idx long")
    return needed.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])


class Prover:
    """Proofs and folds of one partition's leaves, from its own levels and the nodes that came from elsewhere."""

    def __init__(self, stretch: Stretch, more: dict[Key, bytes], root: bytes):
        self.stretch, self.more, self.root = stretch, more, root
        self.sizes = {t: level_sizes(n) for t, n in stretch.sizes.items()}
        self.above: dict[tuple[int, int], tuple[int, bytes]] = {}
        self.folds: dict[tuple[int, int], tuple[int, bytes]] = {}

    def digest(self, tree: int, level: int, i: int) -> bytes:
        start, have = self.stretch.levels[tree][level]
        if start <= i < start + len(have):
            return have[i - start]
        return self.root if tree == TOP and level + 1 == len(self.sizes[TOP]) else self.more[tree, level, i]

    def run(self, tree: int, level: int, i: int) -> list[bytes]:
        first = i // ARITY * ARITY
        return [self.digest(tree, level, j) for j in range(first, min(first + ARITY, self.sizes[tree][level]))]

    def siblings(self, tree: int, level: int, i: int) -> bytes:
        """All siblings from this node up to the root, as text. The last one of each level is remembered."""
        if level + 1 == len(self.sizes[tree]):
            return b"" if tree == TOP else self.siblings(TOP, 0, tree)
        known = self.above.get((tree, level))
        if level and known and known[0] == i:
            return known[1]
        run = self.run(tree, level, i)
        found = b"".join([*run[: i % ARITY], *run[i % ARITY + 1 :], self.siblings(tree, level + 1, i // ARITY)])
        if level:
            self.above[tree, level] = (i, found)
        return found

    def folded(self, tree: int, level: int, i: int, digest: bytes) -> bytes:
        """The root that follows if this node has the given digest and its siblings are as they are."""
        if level + 1 == len(self.sizes[tree]):
            return digest if tree == TOP else self.folded(TOP, 0, tree, digest)
        own = digest == self.digest(tree, level, i)
        known = self.folds.get((tree, level))
        if own and known and known[0] == i // ARITY:  # what the run gives was folded for a sibling
            return known[1]
        run = self.run(tree, level, i)
        run[i % ARITY] = digest
        found = self.folded(tree, level + 1, i // ARITY, node(run))
        if own:
            self.folds[tree, level] = (i // ARITY, found)
        return found


def proven(leaves: DataFrame, told: DataFrame, context: DataFrame, root: bytes, n_parts: int, paths: bool) -> DataFrame:
    key = leaves.schema["key"]
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = leaves.select("part", "place", "key", "digest", "claim", "by", null("share", "array<long>"), null("node", "array<long>"))
    empty = [null("key", key.dataType), null("claim", "binary"), null("by", "binary")]
    heads = told.select("part", F.lit(-2).cast("long").alias("place"), null("digest", "binary"), "share", null("node", "array<long>"), *empty)
    others = context.select("part", F.lit(-1).cast("long").alias("place"), "digest", null("share", "array<long>"), F.array("tree", F.col("level").cast("long"), "idx").alias("node"), *empty)
    ready = rows.unionByName(heads).unionByName(others).repartition(n_parts, "part").sortWithinPartitions("part", "place")
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([key, T.StructField("tree", T.LongType()), T.StructField("idx", T.LongType()), *(T.StructField(c, T.StringType()) for c in texts), T.StructField("verified", T.BooleanType())])
    if paths:
        schema = T.StructType([*schema.fields, T.StructField("siblings", T.ArrayType(T.StringType()))])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_part(batches):
            place = t.column("place").to_numpy()
            first = int((place < 0).sum())
            digests = [d and d.hex().encode() for d in t.column("digest").to_pylist()]
            more = {tuple(k): d for k, d in zip(t.column("node").to_pylist()[1:first], digests[1:first], strict=True)}
            stretch = Stretch(Share(*t.column("share")[0].as_py()), digests[first:], t.column("by").to_pylist()[first:])
            prover = Prover(stretch, more, root)
            claims = t.column("claim").to_pylist()[first:]
            ends = [*stretch.starts[1:], len(claims)]
            for k, (a, b) in enumerate(zip(stretch.starts, ends, strict=True)):
                tree, base = stretch.share.tree + k, stretch.share.base if k == 0 else 0
                subroot = prover.digest(TOP, 0, tree)
                for lo in range(a, b, 4096):
                    yield some(t, prover, tree, base - a, subroot, digests, claims, first, lo, min(lo + 4096, b))

    def some(t: pa.Table, prover: Prover, tree: int, shift: int, subroot: bytes, digests: list, claims: list, first: int, lo: int, hi: int) -> pa.RecordBatch:
        own = digests[first + lo : first + hi]
        proofs = [prover.siblings(tree, 0, i + shift) for i in range(lo, hi)]
        folds = [prover.folded(tree, 0, i + shift, claims[i].hex().encode() if claims[i] is not None else d) for i, d in zip(range(lo, hi), own, strict=True)]
        text = lambda values: pa.array([v.decode() for v in values], pa.string())
        columns = [
            t.column("key").slice(first + lo, hi - lo).combine_chunks(), pa.array([tree] * (hi - lo), pa.int64()), pa.array(range(lo + shift, hi + shift), pa.int64()), text(own), text([subroot] * len(own)),
            text([prover.root] * len(own)), pa.array([hashlib.sha256(p).hexdigest() for p in proofs], pa.string()), text(folds), pa.array([f == prover.root for f in folds], pa.bool_()),
        ]
        if paths:
            columns.append(pa.array([[p[j : j + 64].decode() for j in range(0, len(p), 64)] for p in proofs], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ready.mapInArrow(prove, schema)


class Grown(NamedTuple):
    """What the leaves have grown to: the partitions' shares, their number, all nodes of the forests, the root."""

    told: DataFrame
    parts: int
    nodes: DataFrame
    root: str | None


def grow(leaves: DataFrame) -> Grown:
    known = shares_of(leaves)
    told = leaves.sparkSession.createDataFrame([(s.part, list(s)) for s in known], "part long, share array<long>")
    parts = known[-1].part + 1 if known else 1
    rounds = tree_reduce(forests(leaves, told, parts), parts, known[0].all_trees if known else 0)
    nodes = reduce(DataFrame.unionByName, (r.where("made") for r in rounds))
    top = rounds[-1].where(f"open and tree = {TOP}").select("digest").first()
    return Grown(told, parts, nodes, bytes(top.digest).hex() if top else None)


def proofs(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, by: str = "source", key: str = "doc_id",
    claimed: Callable[[DataFrame], dict[str, Column]] | None = None, paths: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, tree and idx (place of the leaf), leaf, subroot, root, proof_sha256, folded_root, verified.

    ``claimed`` gives columns that a holder of the row claims instead of its own; the fold starts at the leaf that they
    make and goes up along the siblings of the manifest, so ``verified`` tells whether the claim is what was hashed.
    ``paths`` adds the siblings themselves, from the leaf's up to those of the subroot, left to right.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as made:
        leaves = sorted_leaves(docs, columns, by, key, claimed(docs) if claimed else {})
        grown = grow(leaves)
        context = cut(paths_from_outside(grown.nodes, grown.told))
        out = cut(proven(leaves, grown.told, context, (grown.root or "").encode(), grown.parts, paths))
        made.keep(out)
    return out


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, by: str = "source", key: str = "doc_id") -> tuple[str | None, DataFrame]:
    """The root of ``docs``, and (tree, subroot) of each group, ``tree`` being its place among the groups; written."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as made:
        grown = grow(sorted_leaves(docs, columns, by, key, {}))
        subroots = cut(grown.nodes.where(f"tree = {TOP} and level = 0").select(F.col("idx").alias("tree"), F.lower(F.hex("digest")).alias("subroot")))
        made.keep(subroots)
    return grown.root, subroots


def tampered(docs: DataFrame) -> dict[str, Column]:
    """The text with A-Z lower-cased, where 5 divides the crc32 of the decimal doc_id; a null doc_id is left alone."""
    low = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(hit, low).otherwise(docs["text"])}


def manifest_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, after tampering."""
    found = proofs(docs, claimed=tampered)
    return found.select(F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SQL_LEVELS = 7  # ARITY ** 7 leaves a group, ARITY ** 7 groups


def _level_sql(prefix: str, level: int) -> str:
    """Nodes of the next level, of groups that aren't one node yet, and the runs that they come from."""
    was, now = f"{prefix}{level}", f"{prefix}{level + 1}"
    return f"""{now} AS (SELECT g, i // {ARITY} AS i, (n + {ARITY - 1}) // {ARITY} AS n, list(h ORDER BY i) AS run, sha256(string_agg(h, '' ORDER BY i)) AS h
  FROM {was} WHERE n > 1 GROUP BY g, i // {ARITY}, n)"""


def _steps_sql(prefix: str) -> tuple[str, str]:
    """Joins up the levels from a leaf, and its siblings as text."""
    joins = [f"LEFT JOIN {prefix}{k} {prefix}n{k} ON {prefix}n{k}.g = {prefix}g AND {prefix}n{k}.i = {prefix}i // {ARITY**k}" for k in range(1, SQL_LEVELS + 1)]
    others = lambda k: f"list_filter({prefix}n{k}.run, lambda x, j: j <> {prefix}i // {ARITY ** (k - 1)} % {ARITY} + 1)"
    siblings = " || ".join(f"CASE WHEN {prefix}n{k}.g IS NULL THEN '' ELSE array_to_string({others(k)}, '') END" for k in range(1, SQL_LEVELS + 1))
    return "\n  ".join(joins), siblings


def _fold_sql(prefix: str, start: str, end: str) -> str:
    """CTEs that fold ``claim`` up the levels."""
    steps = []
    for k in range(1, SQL_LEVELS + 1):
        was = start if k == 1 else f"{prefix}f{k - 1}"
        place = f"d.{prefix}i // {ARITY ** (k - 1)} % {ARITY}"
        run = f"array_to_string(list_transform(m.run, lambda x, j: CASE WHEN j = {place} + 1 THEN d.claim ELSE x END), '')"
        steps.append(f"""{end if k == SQL_LEVELS else f'{prefix}f{k}'} AS (SELECT d.* REPLACE (CASE WHEN m.g IS NULL THEN d.claim ELSE sha256({run}) END AS claim)
  FROM {was} d LEFT JOIN {prefix}{k} m ON m.g = d.{prefix}g AND m.i = d.{prefix}i // {ARITY**k})""")
    return ",\n".join(steps)


_TEXT = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_TEXT.format(c) for c in COLUMNS) + ")"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(doc_id::VARCHAR)), lambda k: unicode(substr(doc_id::VARCHAR, k + 1, 1))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)))"

#: All levels spelled out, from the definition; rows of equal group and key by their leaf.
REPORT_SQL = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
own AS (SELECT doc_id, source, {_LEAF} AS h, {_CRC} % 5 = 0 AS hit, lang, n_chars,
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents, tab),
both_leaves AS (SELECT doc_id, source, h, CASE WHEN hit THEN {_LEAF} ELSE h END AS claim FROM own),
placed AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tg,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS ti, count(*) OVER (PARTITION BY source) AS n FROM both_leaves),
t0 AS (SELECT tg AS g, ti AS i, n, h FROM placed),
{", ".join(_level_sql("t", k) for k in range(SQL_LEVELS))},
subroots AS ({" UNION ALL ".join(f"SELECT g, h FROM t{k} WHERE n = 1" for k in range(SQL_LEVELS + 1))}),
s0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM subroots),
{", ".join(_level_sql("s", k) for k in range(SQL_LEVELS))},
root AS ({" UNION ALL ".join(f"SELECT h FROM s{k} WHERE n = 1" for k in range(SQL_LEVELS + 1))}),
leaves AS (SELECT p.doc_id, p.h AS leaf, p.claim, p.tg, p.ti, 0 AS sg, p.tg AS si, subroots.h AS subroot, root.h AS root
  FROM placed p JOIN subroots ON subroots.g = p.tg, root),
proofs AS (SELECT leaves.*, sha256({_steps_sql("t")[1]} || {_steps_sql("s")[1]}) AS proof_sha256 FROM leaves
  {_steps_sql("t")[0]}
  {_steps_sql("s")[0]}),
{_fold_sql("t", "proofs", "folded")},
{_fold_sql("s", "folded", "done")}
SELECT doc_id, leaf, subroot, root, proof_sha256, claim AS folded_root, claim = root AS verified FROM done
"""
