"""Language identification: sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, runs of anything else become one space, and hashed n-grams of one to ``LONGEST`` characters
are weighted by TF-IDF: document frequencies are counted over all documents that may be learned from. The regression is
trained with follow-the-regularised-leader and elastic-net penalties, which leave most weights at exactly zero, on a
bounded sample: ``2 * max_train`` documents, taken from all languages in turn in the order of a hash of their ids, so a
rare language has as many as a common one while it has any. Of each language every other document, from the first one
on, is trained on; the rest set the temperature that calibrates the probabilities. Predictions see nothing but the text,
which is read whole.

Learned from are only documents with a language whose crc32(doc_id as text) modulo ``folds`` is not 0; the others are
held out.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null doc_id is neither held out nor
learned from; with no language to learn every prediction is ``und``, with one it is that one; repeated rows come out
once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.llm.common import cut, ship

LONGEST = 3
BUCKETS = 1 << 14
OTHER = re.compile(r"[^\w]+|[\d_]+")
UNKNOWN = "und"


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences of the hashed n-grams of a text; None without letters."""
    if not text:
        return None
    letters = OTHER.sub(" ", text.lower()).strip()
    letters = re.sub(" +", " ", letters)
    if not any(map(str.isalpha, letters[:64])) and not any(map(str.isalpha, letters)):
        return None
    x = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h[: len(x) - n + 1] * np.uint64(0x100000001B3)) ^ (x[n - 1 :] + np.uint64(n))
        mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        found += np.bincount(mixed.astype(np.int64), minlength=BUCKETS)
    return found


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the TF-IDF vector of length 1, with logarithmic term frequencies."""
    at = np.flatnonzero(found)
    v = (1 + np.log(found[at])) * idf[at]
    return at, v / max(1e-12, math.sqrt(v @ v))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(*weighted(found, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def document_frequencies(learnable: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of documents with letters, and in how many of them each bucket occurs; a task sends a bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = counts(t)
                if found is not None:
                    n += 1
                    seen += found > 0
        at = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": np.r_[-1, at].astype(np.int64), "n": np.r_[n, seen[at]].astype(np.int64)})

    rows = learnable.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 0
    for r in rows:  # at most BUCKETS + 1
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return n, df


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the softmax loss: per-coordinate rates, weights at zero while |z| <= l1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def leader(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - np.where(at[:, None] == BUCKETS, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v, y = rows[i]
            at, v = np.r_[at, BUCKETS], np.r_[v, 1.0]
            w = leader(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = math.log(0.25), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 5, max_train: int = 3000,
        alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> Model:
    ship(docs.sparkSession)
    learnable = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), folds))
    n, df = document_frequencies(learnable, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = learnable.select(F.col(doc_id).cast("long").alias("sample_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.join(F.broadcast(sampled(rows, 2 * max_train)), ["sample_id", "lang"])
    one = rows.groupBy("sample_id", "lang", "turn").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # repeated ids count once

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "turn": [], "at": [], "v": []}
            for y, turn, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "turn", "text")), strict=True):
                found = counts(t)
                if found is not None:
                    at, v = weighted(found, idf)
                    for c, x in zip(out, (y, turn, at.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()), strict=True):
                        out[c].append(x)
            yield pa.record_batch({"lang": pa.array(out["lang"], pa.string()), "turn": pa.array(out["turn"], pa.int32()), "at": pa.array(out["at"], pa.binary()), "v": pa.array(out["v"], pa.binary())})

    found = one.select("lang", "turn", "text").mapInArrow(vectors, "lang string, turn int, at binary, v binary").orderBy("turn", "lang")
    known: list[tuple[np.ndarray, np.ndarray, str, bool]] = [
        (np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32).astype(float), r["lang"], r["turn"] % 2 == 1) for r in found.toLocalIterator()
    ]  # at most 2 * max_train documents
    languages = sorted({y for _, _, y, _ in known})
    if len(languages) < 2:
        return Model(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    data, rest = ([(at, v, languages.index(y)) for at, v, y, trained in known if trained is wish] for wish in (True, False))
    weights, bias = follow_the_leader(data, len(languages), alpha, beta, l1, l2, epochs)
    model = Model(languages, idf, weights.astype(np.float32), bias)
    if rest:
        model.temperature = fitted_temperature(np.array([model.logits(at, v) for at, v, _ in rest]), np.array([y for _, _, y in rest]))
    return model


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """(sample_id, lang, turn) of at most ``most`` documents: the first of every language, then the second of each, and so on.

    No task sorts a language: of each, a task keeps ``most`` rows at the most before they meet.
    """
    order = F.xxhash64(F.col("sample_id").cast("string"))
    ids = rows.select("sample_id", "lang").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(order, "sample_id"))
    return cut(ids.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", order, "sample_id", "lang").limit(most))


def predictions(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", folds: int = 5) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id), folds).alias("held_out"), F.col(text).cast("string"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
