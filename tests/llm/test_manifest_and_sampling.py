"""Importance resampling and the Merkle manifest, against plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck_rows, rows_of

from contextloom.llm import importance, merkle
from contextloom.llm.common import words_of


# ---- importance resampling ----
def plain_ranks(docs, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) in the order of the table."""

    def bag(text):
        w = words_of((text or "").encode())
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    bags = [bag(t) for _, t in docs]
    s, t = Counter(b for _, f in bags for b in f), Counter(b for x in target for b in bag(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for (doc_id, _), (n_words, f) in zip(docs, bags, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    ranks = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(place)
    return sorted(((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=repr)


TARGET = ["alpha beta gamma", None, "Beta beta delta", "w1 w2 w3 w4"]


@pytest.mark.parametrize("max_n, buckets, min_words, percent", [(1, 10_000, 20, 10), (2, 50, 2, 60), (3, 7, 0, 100)])
def test_ranks_equal_plain(spark, plain, max_n, buckets, min_words, percent):
    docs = plain.unionByName(spark.createDataFrame([(d, f"alpha w{d % 3} beta word" * (d % 7), None, None, None) for d in range(20, 60)], "doc_id long, text string, lang string, source string, n_chars long"), True)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.importance_ranks(docs, target, max_n=max_n, buckets=buckets, min_words=min_words, percent=percent)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr) == plain_ranks(rows, TARGET, max_n, buckets, min_words, percent)


def test_drawn_rows_keep_their_columns(spark, plain, none):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    kept = importance.resample(plain, target, min_words=0, percent=50)
    ranks = importance.importance_ranks(plain, target, min_words=0, percent=50).where("rank is not null")
    assert kept.columns == plain.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in ranks.collect()), key=repr)
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, plain.count() // 2 + 1))
    assert importance.resample(none, target).count() == 0 and importance.resample_report(none, target).count() == 0
    assert importance.resample_report(plain, none.select("text")).count() == plain.count()


def test_a_third_of_all_rows_equal(spark):
    rows = [(7, "same words here " * 9)] * 100 + [(i, f"text {i} of some words " * 5) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = importance.resample_report(docs, spark.createDataFrame([("same words",)], "text string"))
    assert rows_of(got) == sorted(((r[0], r[1], r[4], r[3], r[2]) for r in plain_ranks(rows, ["same words"])), key=repr)


# ---- Merkle manifest ----
def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(r))):
        groups.setdefault(r[1], []).append(r)
    trees = [plain_levels([plain_leaf(r) for r in g]) for g in groups.values()]
    top = plain_levels([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for k, (g, tree) in enumerate(zip(groups.values(), trees, strict=True)):
        for i, r in enumerate(g):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None and hit else r[4]
            fold, proof = plain_leaf((*r[:4], low)), ""
            for levels, at in ((tree, i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    proof += "".join(run[: at % 16] + run[at % 16 + 1 :])
                    run[at % 16] = fold
                    fold, at = digest("".join(run)), at // 16
            out.append((r[0], tree[0][i], tree[-1][0], root, digest(proof), fold, fold == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def report(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest_report(df).collect()), key=repr)


def test_manifest_edges(spark, plain, none):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    assert report(plain) == plain_manifest([tuple(r[c] for c in names) for r in plain.collect()])
    assert report(none) == [] and merkle.manifest(none)[0] is None
    one = plain.where("doc_id = 4")
    (r,) = merkle.manifest_report(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest("")


@pytest.mark.parametrize("parts, rows, groups, hot", [("1", 40, 1, 0), ("3", 700, 3, 300), ("40", 900, 40, 300), ("64", 5000, 3, 4000)])
def test_manifest_over_many_partitions(spark, parts, rows, groups, hot):
    data = [(i * 7919 % 100_003, None if i % groups == 1 else "s0" if i < hot else f"s{i % groups}é", "en", i, f"Text {i}") for i in range(rows)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
        assert report(df) == plain_manifest(data)
        root, subroots = merkle.manifest(df)
        found = merkle.proofs(df, paths=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {r.root for r in found} == {root} and all(r.verified and r.proof_sha256 == digest("".join(r.siblings)) for r in found)
    assert {(r.tree, r.subroot) for r in found} == {tuple(r) for r in subroots.select("tree", "subroot").collect()}


def forest_of(sizes, lo, hi):
    """The forest of the leaves [lo, hi) of all trees' leaves in a row, by joining them one at a time."""
    keys = [(t, 0, i) for t, n in enumerate(sizes) for i in range(n)]
    counts = {merkle.TOP: len(sizes)} | dict(enumerate(sizes))
    found = {}
    for k in keys[lo:hi]:
        found, _ = merkle.joined(found, {k: digest(repr(k)).encode()}, counts)
    return found, counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 600), min_size=1, max_size=20), st.data())
def test_forests_join_associatively(sizes, data):
    total = sum(sizes)
    a, b = sorted((data.draw(st.integers(0, total)), data.draw(st.integers(0, total))))
    (x, counts), (y, _), (z, _) = (forest_of(sizes, *s) for s in ((0, a), (a, b), (b, total)))
    left = merkle.joined(merkle.joined(x, y, counts)[0], z, counts)[0]
    right = merkle.joined(x, merkle.joined(y, z, counts)[0], counts)[0]
    assert left == right and len(left) == 1
    levels = [plain_levels([digest(repr((t, 0, i))) for i in range(n)]) for t, n in enumerate(sizes)]
    assert list(left.values()) == [plain_levels([t[-1][0] for t in levels])[-1][0].encode()]
    for part, (lo, hi) in ((x, (0, a)), (y, (a, b)), (z, (b, total))):
        assert len(part) <= 3 * 4 * 30 or hi - lo > total


@pytest.mark.parametrize("name", ["importance", "merkle"])
def test_reports_equal_sql(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    df = merkle.manifest_report(docs) if name == "merkle" else importance.resample_report(docs, spark.read.parquet(f"{small}/benchmark.parquet"))
    columns, expected = duck_rows((merkle if name == "merkle" else importance).REPORT_SQL, small)
    assert sorted(df.columns) == columns and rows_of(df) == expected
