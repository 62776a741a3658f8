"""MinHash near-duplicates against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck_rows, rows_of

from contextloom.llm import minhash, ngram_jaccard


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.minhash_duplicates(df).collect()), key=repr)


def near_copies(r, sizes, copies, share, words=4000):
    """Texts of some sizes, each with copies of which a share of the words up to ``share`` is changed."""
    texts = []
    for n in sizes:
        base = [f"v{x}" for x in r.integers(0, words, n)]
        for k in range(copies):
            w = list(base)
            for i in np.flatnonzero(r.random(n) < share * k / copies):
                w[i] = f"z{r.integers(100_000)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("cell", [2048, 8])  # with 8, long lists are cut into cells and listed anew by rarity
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(ngram_jaccard, "CELL", cell)
    r = np.random.default_rng(5)
    texts = near_copies(r, (2, 5, 9, 20, 60, 100, 110, 128, 129, 140, 160, 400, 900, 2500), 9, 0.12)
    texts += near_copies(r, (40, 300), 12, 0.1, words=60)  # few words: pairs of words that many texts share
    texts += ["the of and to in " * k for k in range(1, 12)] + ["", None, "a b", "A  b", "one", "ONE", "one two three one two", "two one"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(df) == sorted(ngram_jaccard.brute_force(docs, 80, 2), key=repr)


def test_a_passage_and_a_group_of_copies(spark, monkeypatch):
    """A third of the texts are near copies, a third share a passage that makes up half of each."""
    monkeypatch.setattr(ngram_jaccard, "CELL", 16)
    monkeypatch.setattr(ngram_jaccard, "LARGE_TILE", 8)
    r = np.random.default_rng(9)
    texts = near_copies(r, (250,), 60, 0.05)
    passage = " ".join(f"p{i}" for i in range(130))
    texts += [f"{passage} " + " ".join(f"o{i}x{k}" for k in range(110 + i)) for i in range(60)]
    texts += [f"{passage} tail {i} of it" for i in range(20)] + near_copies(r, (150,) * 20, 3, 0.03)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(df) == sorted(ngram_jaccard.brute_force(docs, 80, 2), key=repr)


@pytest.mark.parametrize("own", [14, 60])  # texts that go by rare shingles, and by lists
def test_a_pair_comes_from_one_tile(spark, monkeypatch, own):
    """Texts that share most of their tiles, but aren't linked, are paired once, not once for each tile and size band."""
    monkeypatch.setattr(ngram_jaccard, "CELL", 16)
    made, cross = [], ngram_jaccard.cross_pairs

    def counted(tiles, percent):
        pairs = ngram_jaccard.cut(cross(tiles, percent))
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(ngram_jaccard, "cross_pairs", counted)
    passage = " ".join(f"p{i}" for i in range(7 * own))
    docs = [(i, f"{passage} " + " ".join(f"o{i}x{k}" for k in range(own))) for i in range(40)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == sorted(ngram_jaccard.brute_force(docs, 80, 2), key=repr)
    assert all(rows == pairs for rows, pairs in made) and sum(pairs for _, pairs in made) > 0


def test_edges(plain, none):
    by = {}
    for r in minhash.minhash_report(plain).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by.values())) == len(EDGE)
    assert by[1][0].n_shingles == 0 and by[1][0].component_id == 1 and by[1][0].kept
    assert by[4][0].component_id == by[5][0].component_id == by[None][0].component_id == 4
    assert by[4][0].kept and not by[5][0].kept and not by[None][0].kept
    assert by[12][0].n_shingles == 1 and len(by[12]) == 2
    kept = minhash.minhash_dedup(plain)
    assert kept.columns == plain.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14], key=repr)
    assert minhash.minhash_report(none).count() == 0


def sketch(values):
    h = np.array(sorted(values), np.uint64)
    return minhash.sketch_of(h, minhash.retained(h)).reshape(1, minhash.CELLS, minhash.KEPT)


def mixed(v):
    """A hash of a number, so that values spread over cells and upper bits as those of shingles do."""
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        v = ((v ^ (v >> 31)) * factor + factor) % 2**64
    return v


hashes = st.sets(st.integers(0, 2**40).map(mixed), max_size=600)


@settings(max_examples=60, deadline=None)
@given(hashes, hashes, hashes)
def test_the_sketch_of_a_union_follows_from_the_sketches(a, b, shared):
    a, b = a | shared, b | shared
    size, both = minhash.union_overlap(sketch(a), sketch(b))
    kept = sketch(a | b)[0]
    assert size[0] == (kept != minhash.PAD).sum()
    in_both = {(h % minhash.CELLS, h >> 32) for h in a & b}
    assert both[0] == sum((c, int(v)) in in_both for c in range(minhash.CELLS) for v in kept[c] if v != minhash.PAD)


def test_bounds():
    assert minhash.list_depth(80) == 4 and minhash.list_depth(75) == 3 and minhash.spare_lists(80) == 2
    few = sum(math.comb(minhash.CELLS, k) * 0.8 ** (4 * k) * (1 - 0.8**4) ** (minhash.CELLS - k) for k in range(3))
    assert few <= minhash.FEWER
    least = minhash.least_shared(80)
    for size in (1, 10, 100, 192):
        tail = lambda m, size=size: sum(math.comb(size, k) * 0.8**k * 0.2 ** (size - k) for k in range(m))
        assert tail(least[size]) <= minhash.MISS < tail(least[size] + 1) or least[size] == size


def test_linked_sets_share_lists():
    """Sets at the threshold itself, of all sizes that go by cells: each pair has a list in common."""
    r = np.random.default_rng(3)
    for n in (115, 128, 200, 256, 300, 600, 2000):
        for _ in range(100):
            h = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            differ, some = len(h) // 5, r.permutation(len(h))  # of the union
            a, b = (np.sort(np.delete(h, x)) for x in (some[: differ // 2], some[differ // 2 : differ]))
            x, y = (minhash.list_keys(s, minhash.retained(s), 4) for s in (a, b))
            assert np.intersect1d(x, y).size >= 5


def test_report_equals_sql(spark, small):
    df = minhash.minhash_report(spark.read.parquet(f"{small}/documents.parquet"))
    columns, expected = duck_rows(minhash.REPORT_SQL, small)
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_a_link_that_shows_in_two_lists_only(spark):
    """Of one text the words that all cells but two retain first are changed: the texts still have 80 % in common."""
    words, hashes = [f"v{i}" for i in range(2000)], ngram_jaccard.WordHashes()
    sets = lambda w: ngram_jaccard.shingle_set(" ".join(w).encode(), hashes, minhash.SHINGLE)
    keys = lambda h: set(minhash.list_keys(h, minhash.retained(h), minhash.list_depth(80)).tolist())
    h = sets(words)
    place = {int(sets(words[i : i + 2])[0]): i for i in range(len(words) - 1)}
    other = list(words)
    for cell in minhash.retained(h)[2:]:
        other[place[int(h[cell[0]])]] = f"z{cell[0]}"
    o = sets(other)
    assert 1 <= len(keys(h) & keys(o)) <= 2
    common = len(np.intersect1d(h, o))
    assert 100 * common >= 80 * (len(h) + len(o) - common)
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [c for _, _, c in found(df)] == [1, 1]
