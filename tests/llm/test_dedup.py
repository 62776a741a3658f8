"""Exact and near duplicates, components, decontamination, licenses."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextloom.llm import components, decontaminate, exact_dedup, license_scan, minhash, ngram_jaccard
from contextloom.llm.common import cut, spaced_words, words_of


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_words_are_those_of_the_patterns():
    for t in (*[t for _, t in EDGE], "A1-b_É\x00\x7fz Ω", "ÀÉ K İ"):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert [w.decode() for w in words_of((t or "").encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert [w.decode() for w in spaced_words((t or "").encode())] == re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.mark.parametrize("bits, most", [(16, 1 << 15), (1, 1 << 15), (16, 0)])
def test_exact_report(plain, bits, most):
    rows = plain.collect()
    got = exact_dedup.exact_dedup_report(plain, bits_per_row=bits, max_filter_bits=most).collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        known = [i for i in ids if i is not None]
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)}
        assert {r.keep_id for r in mine} == {min(known) if known else None}
        assert sum(r.kept for r in mine) == 1
        assert [r.doc_id for r in mine if r.kept] == [min(known) if known else None]


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_exact_rows_keep_their_columns(plain, none, most):
    got = exact_dedup.exact_dedup(plain, max_filter_bits=most)
    assert got.columns == plain.columns
    kept = got.collect()
    assert sorted(norm(r.text) for r in kept) == sorted({norm(t) for _, t in EDGE})
    assert all(r.row == "row" for r in kept)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.exact_dedup_report(none).count() == 0


def test_exact_large_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 10)
    docs = spark.range(500).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id % 200)) as text")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup_report(docs).collect()}
    assert got[300].group_size == 167 and got[300].keep_id == 0 and not got[300].kept and got[1].keep_id == 1 and got[201].group_size == 167
    assert sum(r.kept for r in got.values()) == len({"same" if i % 3 == 0 else f"t{i % 200}" for i in range(500)})


def test_repeated_bits_find_every_repeat(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id % 2000) as h")
    out = exact_dedup.maybe_repeated(rows, "h", "m", exact_dedup.filter_blocks(3000, 16)).collect()
    n = {}
    for r in out:
        n[r.h] = n.get(r.h, 0) + 1
    assert all(r.m for r in out if n[r.h] > 1)
    assert sum(r.m for r in out if n[r.h] == 1) < 0.1 * len(out)


def test_a_filter_beyond_the_broadcast_still_clears_unique_rows(spark, monkeypatch):
    """More rows than a bounded filter could tell apart; a third of them equal, in one block of the filter."""
    monkeypatch.setattr(components, "HOT_ROWS", 100)
    n = 60_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', if(id % 100 = 1, concat('t', id div 200), concat('u', id))) as text")
    hashed = cut(docs.selectExpr("doc_id as number", "xxhash64(text) as h", "text"))
    found = {r.number for r in exact_dedup.routed_repeated(hashed.select("number", "h"), exact_dedup.filter_blocks(n, 16), n).collect()}
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    count = Counter(texts)
    assert all(i in found for i in range(n) if count[texts[i]] > 1)
    assert sum(count[texts[i]] == 1 for i in found) < 0.1 * n
    once, again = exact_dedup.split_repeated(docs, F.xxhash64("text"), 16, 1 << 15)
    assert once.count() + again.count() == n and again.count() == len(found)
    kept = exact_dedup.exact_dedup(docs, max_filter_bits=1 << 15).collect()
    assert sorted(r.doc_id for r in kept) == sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())


# ---- near duplicates ----
def near(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(df).collect()), key=repr)


def test_near_equals_brute_force(spark):
    r = np.random.default_rng(5)
    base = [[f"v{x}" for x in r.integers(0, 4000, n)] for n in (12, 40, 80, 150, 400, 900)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06):
            w = list(words)
            for i in np.flatnonzero(r.random(len(w)) < share):
                w[i] = f"z{r.integers(1000)}"
            texts += [" ".join(w), " ".join(w[: int(len(w) * 0.85)])]
    passage = " ".join(base[4][:60])
    texts += [passage + " " + " ".join(f"u{i}x{k}" for k in range(60 + i)) for i in range(40)]
    texts += ["", None, "a b", "A  b", "one"]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert near(df) == sorted(ngram_jaccard.brute_force(docs), key=repr)


def test_near_cells_of_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CELL", 8)
    r = np.random.default_rng(6)
    base = [f"v{x}" for x in r.integers(0, 4000, 120)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, len(w), int(r.integers(0, 9))):
            w[k] = f"z{r.integers(10_000)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert near(df) == sorted(ngram_jaccard.brute_force(docs), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(0, 80))
def test_bitmaps_bound_from_above(a, b, shared):
    b |= set(sorted(a)[:shared])
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    bx, by = ngram_jaccard.bitmap(x), ngram_jaccard.bitmap(y)
    w = min(len(bx), len(by))
    assert ngram_jaccard.most_overlap(ngram_jaccard.folded(bx, w), ngram_jaccard.folded(by, w), np.int64(len(a)), np.int64(len(b))) >= len(a & b)


def test_a_passage_of_many_documents_costs_no_squares(spark, monkeypatch):
    """Tiles of a shared passage are tiled anew by rarity: what is compared grows with the documents, and no link is lost."""
    monkeypatch.setattr(ngram_jaccard, "CELL", 16)
    monkeypatch.setattr(ngram_jaccard, "SLOT_LOAD", 1)
    dealt = []
    cross = ngram_jaccard.cross_pairs

    def counted(tiles, percent):
        dealt.append(tiles.groupBy("key").agg(F.pow(F.count(F.lit(1)), F.lit(2)).alias("p")).agg(F.sum("p")).first()[0] or 0)
        return cross(tiles, percent)

    monkeypatch.setattr(ngram_jaccard, "cross_pairs", counted)
    r = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(120))
    work = {}
    for size in (60, 240):
        docs = []
        for i in range(size):
            own = [f"o{i}x{k}" for k in range(int(r.integers(60, 120)))]
            docs.append((2 * i, passage + " " + " ".join(own)))
            if i % 5 == 0:  # a near copy, by a changed word or two
                own[3] = "other"
                docs.append((2 * i + 1, "a b " + passage + " " + " ".join(own)))
        docs += [(10_000 + i, passage + f" tail {i} of it") for i in range(12)]  # nearly nothing but the passage: all linked
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        dealt.clear()
        assert near(df) == sorted(ngram_jaccard.brute_force(docs), key=repr)
        assert len(dealt) == 2
        work[size] = sum(dealt)
    assert work[240] <= 8 * max(work[60], 100)


def plain_links(docs):
    """(class_a, class_b) -> similarity, by comparing all documents."""
    sets = {}
    for i, t in docs:
        w = spaced_words(t.encode() if t else None)
        if w:
            s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            sets[s] = min(i, sets.get(s, i))
    pairs = [(a, b) for a in sets for b in sets if sets[a] < sets[b]]
    return {(sets[a], sets[b]): len(a & b) / len(a | b) for a, b in pairs if 100 * len(a & b) >= 75 * len(a | b)}


@pytest.mark.parametrize("cell", [2048, 8])  # with 8, large tiles are tiled anew and cut into cells
def test_links_equal_brute_force(spark, monkeypatch, none, cell):
    monkeypatch.setattr(ngram_jaccard, "CELL", cell)
    r = np.random.default_rng(7)
    docs = []
    for n, copies in ((60, 25), (200, 25), (700, 6)):
        base = [f"v{x}" for x in r.integers(0, 4000, n)]
        for _ in range(copies):
            w = list(base)
            for k in r.integers(0, n, int(r.integers(0, max(3, n // 40)))):
                w[k] = f"z{r.integers(10_000)}"
            docs.append((3 * len(docs), " ".join(w)))
    docs += [(3 * i + 1, t) for i, t in docs[:10]] + [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ngram_jaccard.near_links(df).collect()
    want = plain_links(docs)
    assert len(got) == len(want) > 100
    assert {(x.class_a, x.class_b): pytest.approx(x.similarity) for x in got} == want
    if cell == 8:
        assert ngram_jaccard.near_links(none).count() == 0


def test_near_edges(plain, none, spark):
    got = ngram_jaccard.near_duplicates(plain).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_shingles == 0 and by[1][0].component_id == 1
    assert by[4][0].component_id == by[5][0].component_id == by[None][0].component_id == 4
    assert by[9][0].component_id == by[10][0].component_id == 9
    assert by[8][0].n_shingles == 1 and by[7][0].n_shingles == 1
    kept = ngram_jaccard.near_dedup(plain)
    assert kept.columns == plain.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14], key=repr)
    assert ngram_jaccard.near_duplicates(none).count() == 0
    links = [(x.class_a, x.class_b) for x in ngram_jaccard.near_links(plain).collect()]
    assert (9, 10) in links and len(links) == len(set(links))


def test_names_with_dots(spark, tmp_path):
    """Columns are taken by their names as they are."""
    rows = [(i, f"some words of text number {i % 3} and a few more", i, "x") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, `c``d` string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for kept in (exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs, max_filter_bits=0), ngram_jaccard.near_dedup(docs), minhash.minhash_dedup(docs)):
        assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [0, 1, 2]


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [1 << 18, 0])  # smallest neighbours by broadcast, or by joins
def test_components_settle_in_few_tables(spark, monkeypatch, few):
    """Stars are known as such without another round; a chain of 3,000 whose links lie in any order takes a few."""
    made, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or cut(df))
    monkeypatch.setattr(components, "FEW_NODES", few)
    monkeypatch.setattr(components, "FOREST", 300)
    stars = spark.range(10, 1000, 1, 4).selectExpr("id as a", "id % 10 as b")
    got = {r.node: r.component for r in components.connected_components(stars.union(stars)).collect()}
    assert got == {i: i % 10 for i in range(1000)} and len(made) == 1
    made.clear()
    order = np.random.default_rng(7).permutation(3000).tolist()
    chain = spark.createDataFrame([(i + 1, i) for i in order], "a long, b long").repartition(4)
    got = [(r.node, r.component) for r in components.connected_components(chain).collect()]
    assert sorted(got) == [(i, 0) for i in range(3001)] and len(made) <= 12


# ---- decontamination ----
def test_contamination_equals_brute_force(spark):
    r = np.random.default_rng(3)
    word = lambda: f"w{r.integers(30)}"
    items = [(i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate(r.integers(1, 25, 25))] + [(None, "w1 w2 w3"), (3, "w4 w5"), (77, None), (78, "!!"), (79, "")]
    docs = [(i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate(r.integers(0, 80, 60))]
    docs += [(100 + i, f"Foo, {items[i][1].upper()}! bar") for i in range(25)] + [(200, None), (201, ""), (200, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(decontaminate.brute_force(docs, items))
    for words in (1_000_000, 40):
        got = decontaminate.contamination_report(d, b, block_words=words).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected
    kept = sorted(r.doc_id for r in decontaminate.decontaminate(d, b, block_words=40).collect())
    assert kept == sorted(x[0] for x in expected if not x[5])


def test_contamination_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"), (2, "word")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination_report(edge, items).collect()}
    assert got[8].n_hit == 40_000 and got[9].n_hit == 11 and got[9].n_items == 1 and not got[1].contaminated
    assert decontaminate.contamination_report(none, items).count() == 0
    assert decontaminate.contamination_report(edge, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(edge, items).columns == edge.columns
    assert decontaminate.decontaminate(edge, items.limit(0)).count() == len(EDGE)


# ---- licenses ----
def base_places(text):
    w = [x.decode() for x in words_of((text or "").encode())]
    out = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), out


LICENSED = [
    "This work is licensed under the GNU General Public License, version 3.", "cc by cc by", "MIT license, mit License\nmit  license", "Apache license. CC-BY-NC 4.0",
    "gnu general public", "Licensed under the Apache License, Version 2.0.", None, "", "cc", "gnu GNU general public license license",
    "Permission is hereby granted, free of charge, to any nice person obtaining a copy of this software and associated documentation files", "KMIT license mİt license ccby",
]


def test_licenses(spark, edge, none):
    docs = [(i, t) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0])]
    got = license_scan.license_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        n, places = base_places(LICENSED[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x for _, x in places}))), LICENSED[r.doc_id]
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert "mit-text" in labels[10] and "apache-2.0" in labels[5] and "gpl-3.0" in labels[0] and labels[4] == ""
    spans = license_scan.license_spans(spark.createDataFrame(docs[:1], "doc_id long, text string")).collect()
    assert {(s.label, s.first_word, s.last_word) for s in spans} == {("gpl", 6, 9), ("gpl-3.0", 0, 11)}
    assert license_scan.license_report(edge).count() == len(EDGE) and license_scan.license_report(none).count() == 0


def test_versions_tell_licenses_apart(spark):
    texts = [
        "This work is licensed under the GNU General Public License version 2.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 1.1", "Licensed under the Apache License, Version 2.1", "Licensed under the Apache License, Version 2.0",
        "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 International License",
        "licensed under CC BY-SA 4.0", "licensed under CC BY-NC 4.0", "licensed under CC BY-NC 3.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) - {"gpl", "apache", "cc-by", ""} for r in license_scan.license_report(df).collect()}
    assert got == {0: set(), 1: {"gpl-3.0"}, 2: set(), 3: set(), 4: {"apache-2.0"}, 5: set(), 6: {"cc-by-4.0"}, 7: set(), 8: set(), 9: {"cc-by-nc-4.0"}, 10: set(), 11: {"mpl-2.0"}, 12: set()}


def test_repeated_words_are_no_license(spark):
    """A word pair vouches for one place of a template, however often it comes; scrambled texts don't count."""
    mit = dict((label, text) for text, label in license_scan.TEXTS)["mit-full"]
    words = mit.split()
    scrambled = " ".join(" ".join(words[i : i + 4]) for i in range((len(words) - 1) // 4 * 4, -1, -4))
    texts = ["2.0 " * 8, "4.0 " * 7, "cc by " * 6, scrambled, "license version 2 0 " * 40 + LICENSED[5], f"x {mit} y", mit.replace("sublicense", "sub license").replace("tort", "") + " " + mit, " ".join(words[: len(words) // 2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_report(df).collect()}
    assert [got[i].labels for i in range(4)] == ["", "", "cc-by", ""] and all(got[i].score <= 0.5 for i in (0, 1, 3)) and got[2].score == 1
    assert got[4].labels == "apache,apache-2.0" and "mit-full" in got[5].labels and "mit-full" in got[6].labels and got[7].labels == "mit-text"
    spans = {(s.doc_id, s.label, s.first_word, s.last_word) for s in license_scan.license_spans(df).collect()}
    n = len(words_of(mit.encode()))
    assert (5, "mit-full", 1, n) in spans and sum(s[:2] == (6, "mit-full") for s in spans) == 2 and (4, "apache-2.0", 160, 167) in spans
