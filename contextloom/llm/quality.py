"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document. Words and their beginnings that mark poor or toxic text are learned from labels: for each one
the log odds of its document counts, at a lower confidence bound, so that chance finds count for nothing. The strongest
ones of a text, and shares of symbols, capitals, repeats and the like, go into two small logistic regressions. They are
fitted on at most ``max_labelled`` labelled documents, those with the smallest hash of their id, in two folds: no
document is described by counts that it was part of.

Sites. The source of a document names a host and, behind its first slash, a path. Grouped aggregation gives each host
and path its number of documents and their expected good ones. A beta prior, fitted to all hosts by moments, draws the
rates of sparse hosts to the global rate; a second one draws sparse paths to their host. A document's odds are its
classifier's odds times its path's posterior odds over the global odds, both from the other documents only: its own
evidence is taken out of its site's sums, so that it counts once. Documents stay if they are more likely good than not,
and more likely not toxic.

Defined cases: a null or wordless text is poor (kept false) whatever its site; a null source is a host of its own; labels
for unknown documents or with nulls are left out; repeated rows come out once each; without labels of both classes
everything with words stays; an empty table gives an empty result; further columns are kept by ``quality_filter``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.llm.common import Rows, byte_lists, cut, free_name, release, scratch, ship, words_of
from contextloom.llm.components import join_groups

CLASSES = ("low_quality", "toxic")
PREFIXES = (3, 4, 5, 6)  # bytes of a word's beginning
LONGEST_WORD = 40
SYMBOLS, CAPITALS, DIGITS, MARKS = b"#$%&*|@^~<>{}[]\\_=+", bytes(range(65, 91)), b"0123456789", b"!?.,;:"
N_DENSE, TOP = 14, 3
MAX_LEXICON = 50_000
SURE = 1.64  # standard errors below the log odds


def marks_of(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings."""
    h = xxhash.xxh3_64_intdigest
    out = [h(b"=" + word[:LONGEST_WORD])]
    out += [h(b"^" + word[:n]) for n in PREFIXES if len(word) >= n]
    return out


class MarkCache(dict):
    """Word -> its hashes, signed for Arrow; starts anew when large."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > 50_000:
            self.clear()
        value = self[word] = [x - (1 << 64) if x >> 63 else x for x in marks_of(word)]
        return value


class WordScores(dict):
    """Word -> the highest log odds among its marks."""

    def __init__(self, lexicon: dict[int, float]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 150_000:
            self.clear()
        get = self.lexicon.get
        value = self[word] = max(get(x - (1 << 64) if x >> 63 else x, 0.0) for x in marks_of(word))
        return value


def dense(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    n, w = max(1, len(text)), max(1, len(words))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    lines = text.split(b"\n")
    symbols, capitals, digits, marks = share(SYMBOLS), share(CAPITALS), share(DIGITS), share(MARKS)
    unique = len(distinct) / w
    return [
        1.0, math.log1p(w), symbols, float(symbols > 0.02), capitals, float(capitals > 0.3), digits, marks,
        unique * math.sqrt(math.log1p(w)), float(unique < 0.3), 1 - len(set(lines)) / len(lines), sum(map(len, distinct)) / max(1, len(distinct)) / 10,
        float(w < 5), math.log1p(w / len(lines)),
    ]


def strongest(distinct: set[bytes], scores: WordScores) -> list[float]:
    found = sorted((s for s in map(scores.__getitem__, distinct) if s > 0), reverse=True)[:TOP]
    found += [0.0] * (TOP - len(found))
    return [found[0], float(found[0] > 0), sum(found[1:]) / (TOP - 1)]


def features(text: bytes | None, scores: tuple[WordScores, ...]) -> list[float]:
    words = words_of(text)
    distinct = set(words)
    out = dense(text or b"", words, distinct)
    for s in scores:
        out += strongest(distinct, s)
    return out


@dataclass
class Model:
    """Log odds of marks by class, and the weights of the two regressions; ``priors`` are rates in the labels."""

    lexicons: tuple[dict[int, float], ...] = ({}, {})
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.r_[-12.0, np.zeros(N_DENSE + 5)], (2, 1)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_DENSE + 6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_DENSE + 6))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights.T, -12, 12)


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, max_labelled: int) -> DataFrame:
    """(text, fold, low, toxic) of the sample, written; ``max_labelled`` bounds it, repeated ids count once."""
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    one = usable.groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("low"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = cut(sample.select(F.col("doc_id").alias("labelled_id"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"), "low", "toxic"))
    texts = docs.select(F.col(doc_id).cast("long").alias("labelled_id"), F.col(text).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "labelled_id").groupBy("labelled_id", "fold", "low", "toxic")
    return cut(found.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "fold", "low", "toxic"))


def mark_counts(sample: DataFrame) -> DataFrame:
    """Per fold and mark: documents, poor ones and toxic ones; each task sends a mark once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = MarkCache()
        found: dict[int, list[np.ndarray]] = {}  # by fold and labels
        for batch in batches:
            codes = sum(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) * w for i, w in ((1, 4), (2, 2), (3, 1)))
            for t, code in zip(byte_lists(batch.column(0)), codes.tolist(), strict=True):
                marks = {m for w in set(words_of(t)) for m in cache[w]}
                found.setdefault(code, []).append(np.fromiter(marks, np.int64, len(marks)))
        for code, parts in found.items():
            marks, n = np.unique(np.concatenate(parts), return_counts=True)
            fold, low, toxic = code >> 2, code >> 1 & 1, code & 1
            yield pa.record_batch({"fold": np.full(len(n), fold, np.int32), "mark": marks, "n": n, "low": n * low, "toxic": n * toxic})

    counted = sample.mapInArrow(count, "fold int, mark long, n long, low long, toxic long")
    return counted.groupBy("fold", "mark").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic")))


def sure_odds(n: Column, hits: Column, all_n: float, all_hits: float) -> Column:
    """Lower bound of log P(mark | class) - log P(mark | not class), from document counts."""
    a, b = hits + 0.5, n - hits + 0.5
    return F.log(a / (all_hits + 1)) - F.log(b / (all_n - all_hits + 1)) - SURE * F.sqrt(1 / a + 1 / b)


def lexicons(counts: DataFrame, totals: dict[int, tuple[int, int, int]], folds: tuple[int, ...]) -> tuple[dict[int, float], ...]:
    """Marks with log odds surely above 0, counted in ``folds``; at most ``MAX_LEXICON`` a class, the surest."""
    n, *hits = (sum(totals.get(f, (0, 0, 0))[i] for f in folds) for i in range(3))
    merged = counts.where(F.col("fold").isin(*folds)).groupBy("mark").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic")))
    out = []
    for column, h in zip(("low", "toxic"), hits, strict=True):
        odds = sure_odds(F.col("n"), F.col(column), n, h).alias("odds")
        rows = merged.where(F.col(column) >= 3).select("mark", odds).where("odds > 0.5").orderBy(F.desc("odds"), "mark").limit(MAX_LEXICON)
        out.append({r.mark: r.odds for r in rows.collect()})
    return tuple(out)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's method; the first column is the constant and has no penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_labelled: int = 12_000, penalty: float = 1.0) -> Model:
    ship(docs.sparkSession)
    sample = labelled_texts(docs, labels, text, doc_id, max_labelled)
    totals = {r.fold: (r.n, r.low, r.toxic) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).collect()}
    if not totals:
        return Model()
    counts = cut(mark_counts(sample))
    by_other_fold = {f: lexicons(counts, totals, (1 - f,)) for f in (0, 1)}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = {f: tuple(map(WordScores, x)) for f, x in by_other_fold.items()}
        for batch in batches:
            fold = batch.column(1).to_pylist()
            x = [features(t, scores[f]) for t, f in zip(byte_lists(batch.column(0)), fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["x", "low", "toxic"])

    rows = sample.mapInArrow(describe, "x array<double>, low int, toxic int").collect()  # at most max_labelled
    x = np.array([r.x for r in rows])
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    z = (x - mean) / scale
    weights = []
    for column in ("low", "toxic"):
        y = np.array([r[column] for r in rows], float)
        weights.append(logistic(z, y, penalty) if 0 < y.sum() < len(y) else np.r_[-12.0 if not y.sum() else 12.0, np.zeros(x.shape[1] - 1)])
    return Model(lexicons(counts, totals, (0, 1)), np.array(weights), mean, scale)


def site_columns(source: Column) -> tuple[Column, Column]:
    """Host and first step of the path of a source or URL."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.split(bare, r"[/?#]", 2)[0], F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)


def scored(rows: Rows, model: Model, text: str, doc_id: str, source: str) -> DataFrame:
    """Per row: row, doc_id, host, site, words, and the classifier's log odds of low quality and toxicity. Written."""
    docs = rows.docs
    ship(docs.sparkSession)
    host, path = site_columns(F.col(source).cast("string"))
    row = free_name(docs, "quality_row")
    picked = rows.numbered(row).select(
        F.col(row), F.col(doc_id).cast("long").alias("doc_id"), host.alias("host"),
        F.concat_ws("/", host, path).alias("site"), F.col(text).cast("string").alias("text"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = tuple(map(WordScores, model.lexicons))
        for batch in batches:
            texts = byte_lists(batch.column(4))
            x = np.array([features(t, scores) for t in texts]).reshape(-1, len(model.mean))
            z = model.logits(x)
            n = np.array([bool(words_of(t)) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(n, pa.int64()), pa.array(z[:, 0]), pa.array(z[:, 1])], names=["row", "doc_id", "host", "site", "n_words", "low", "toxic"]
            )

    return cut(picked.mapInArrow(score, "row long, doc_id long, host string, site string, n_words long, low double, toxic double"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def beta_strength(groups: DataFrame, n: str, good: str, rate: Column) -> float:
    """Pseudo-counts of a beta prior by moments: how little the groups' rates differ beyond chance."""
    var = F.col(n) * F.pow(F.col(good) / F.col(n) - rate, 2)
    r = groups.agg(F.sum(n).alias("n"), F.sum(F.pow(F.col(n), 2)).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(var).alias("v"), F.sum(F.col(n) * rate * (1 - rate)).alias("c")).first()
    if not r.n or r.k < 2 or r.c <= 0:
        return 100.0
    mean_c = r.c / r.n
    between = (r.v - (r.k - 1) * mean_c) / (r.n - r.nn / r.n)
    return min(max(mean_c / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0


@dataclass
class Prior:
    """The global rate of a class, and the pseudo-counts that hosts and paths are drawn to their parents with."""

    rate: float
    hosts: float
    paths: float

    def shift(self, p: Column, n: str, s: str, host_n: str, host_s: str) -> Column:
        """Log odds of a path's posterior over the global ones, without the document of probability ``p`` itself."""
        rest = lambda total: F.greatest(F.lit(0.0), F.col(total) - p)
        host = (rest(host_s) + self.rate * self.hosts) / (F.col(host_n) - 1 + self.hosts)
        path = (rest(s) + host * self.paths) / (F.col(n) - 1 + self.paths)
        return F.log(path / (1 - path)) - math.log(self.rate / (1 - self.rate))


def site_priors(scores: DataFrame) -> tuple[DataFrame, dict[str, Prior]]:
    """(site, n, host_n, and for each class its sums of probabilities in site and host), written, and the classes' priors."""
    kinds = ("low", "toxic")
    sums = [F.sum(sigmoid(F.col(k))).alias(k) for k in kinds]
    sites = cut(scores.groupBy("host", "site").agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts = cut(sites.groupBy("host").agg(F.sum("n").alias("host_n"), F.count(F.lit(1)).alias("k"), *(F.sum(k).alias(f"host_{k}") for k in kinds)))
    joined = cut(join_groups(sites, hosts, "host", "k", sites.count()).drop("k"))
    total = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_{k}").alias(k) for k in kinds)).first()
    priors = {}
    for k in kinds:
        rate = min(max((total[k] or 0.0) / (total.n or 1), 1e-4), 1 - 1e-4)
        strength = beta_strength(hosts, "host_n", f"host_{k}", F.lit(rate))
        host_rate = (F.col(f"host_{k}") + rate * strength) / (F.col("host_n") + strength)
        priors[k] = Prior(rate, strength, beta_strength(joined, "n", k, host_rate))
    release(sites, hosts)
    return joined.select("site", "n", "host_n", *(F.col(c).alias(f"site_{c}") for c in kinds), *(f"host_{c}" for c in kinds)), priors


def quality_rows(rows: Rows, model: Model, text: str, doc_id: str, source: str) -> DataFrame:
    scores = scored(rows, model, text, doc_id, source)
    sites, priors = site_priors(scores)
    both = join_groups(scores, sites, "site", "n", scores.count())
    shift = {k: prior.shift(sigmoid(F.col(k)), "n", f"site_{k}", "host_n", f"host_{k}").alias(f"{k}_shift") for k, prior in priors.items()}
    both = both.select("row", "doc_id", "host", "n_words", "low", "toxic", *shift.values())
    p_low, p_toxic = sigmoid(F.col("low") + F.col("low_shift")), sigmoid(F.col("toxic") + F.col("toxic_shift"))
    return both.select(
        "row", "doc_id", "host", (1 - sigmoid(F.col("low"))).alias("p_document"), (1 - p_low).alias("p_quality"), p_toxic.alias("p_toxic"),
        (-F.col("low_shift")).alias("site_shift"), ((p_low < 0.5) & (p_toxic < 0.5) & (F.col("n_words") > 0)).alias("kept"),
    )


def quality_scores(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Per document: row, doc_id, host, p_document and p_quality (good), p_toxic, site_shift, kept."""
    return quality_rows(Rows(docs), model, text, doc_id, source)


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", max_labelled: int = 12_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows leave by their lasting numbers (``common.Rows``), whatever splits and executors later readings have; texts never
    shuffle.
    """
    rows = Rows(docs)
    with scratch(docs.sparkSession) as made:
        found = quality_rows(rows, fit(rows.docs, labels, text, doc_id, max_labelled), text, doc_id, source)
        gone = cut(found.where("not kept").select("row"))
        made.keep(gone)
    out = rows.pick(gone, keep=False)
    release(gone)
    return out
