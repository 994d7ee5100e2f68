"""Toxicity: a factorization machine over hashed terms.

Terms are words (runs of letters and digits, A-Z lower-cased) and the first bytes of longer words, hashed to 2**30 buckets. A
text's score is the logistic of w0 + sum w_i + sum_{i<j} <v_i, v_j> over its distinct terms, so pairs count that are harmless one
by one. The model is learnt on the driver from a bounded sample of labelled rows and sent to the workers; it holds at
most ``MODEL_TERMS`` terms and ``PAIR_TERMS`` more that matter in pairs, whatever the input.

Nulls and empty texts have no terms: they get the score of w0 alone. Rows of ``labels`` with nulls are left out; of repeated
rows for one document the larger label counts, and of rows that share an id the least text is learnt from, while each is scored by its own text.
Without labels of both kinds all scores are 0. Texts are scored whole; equal texts get equal scores. A column named score or predicted is replaced; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import MARKS, Stored, texts
from .decontaminate import member

#: Labelled rows that a model is learnt from, at most: those with the least hash of their id.
SAMPLE = 12_000
MODEL_TERMS, FACTORS, BEGINNINGS, MIN_DOCS = 20_000, 4, (4, 5), 3
THRESHOLD = 0.7
#: Terms are learnt if their rate of positive texts is ODD standard errors off the mean, or that of a pair of the PAIR_TERMS commonest ones
#: PAIR_ODD off what the two alone add up to.
ODD, PAIR_ODD, PAIR_TERMS = 4.0, 12.0, 2000
#: Share of a text's terms left out at random in each round, so that no term relies on others to come with it.
LEFT_OUT = 0.5


def terms(w) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all terms of some texts, repeated as they occur."""
    parts = [(w.hash, w.doc), *((h, w.doc[at]) for h, at in map(w.beginnings, BEGINNINGS))]
    return np.concatenate([h for h, _ in parts]) >> np.uint64(34), np.concatenate([d for _, d in parts])


def _pairs(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket), by document. Buckets have 30 bits."""
    code = np.unique(doc.astype(np.uint64) << np.uint64(30) | bucket)
    return (code >> np.uint64(30)).astype(np.int64), code & np.uint64((1 << 30) - 1)


class Machine:
    def __init__(self, keys: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.keys, self.bias, self.weight, self.factor = keys, bias, weight, factor

    def score(self, w, n: int) -> np.ndarray:
        bucket, doc = terms(w)
        hit = member(bucket, self.keys)
        doc, bucket = _pairs(bucket[hit], doc[hit])
        at = np.searchsorted(self.keys, bucket)
        z = self.bias + np.bincount(doc, self.weight[at], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[at, f]
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def paired(columns: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """Which of the n terms stand in a pair whose rate of positive texts is PAIR_ODD standard errors off what the two rates alone add up to; counts of all pairs, in blocks of texts."""
    total, pos = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for lo in range(0, len(y), 1000):
        x = np.zeros((len(columns[lo : lo + 1000]), n), np.float32)
        for i, c in enumerate(columns[lo : lo + 1000]):
            x[i, c] = 1
        total += x.T @ x
        bad = x[y[lo : lo + 1000] > 0]
        pos += bad.T @ bad
    mean = y.mean()
    own = np.diag(pos) / np.maximum(np.diag(total), 1)
    np.fill_diagonal(total, 0)
    odd = np.zeros(n, bool)
    for lo in range(0, n, 100):  # in strips: as a whole, each step would take as much again as the counts, in doubles
        here, there = total[lo : lo + 100], pos[lo : lo + 100]
        alone = np.clip(own[lo : lo + 100, None] + own[None, :] - mean, 0, 1)
        odd[lo : lo + 100] = ((here >= MIN_DOCS) & (np.abs(there - here * alone) >= PAIR_ODD * np.sqrt(np.maximum(here, 1) * mean * (1 - mean)))).any(1)
    return odd


def learn(keys: np.ndarray, columns: list[np.ndarray], y: np.ndarray, epochs: int = 20, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine | None:
    """A machine from the places in ``keys`` of each sampled text's distinct terms, and its label: Adam on the logistic loss."""
    if len(set(y.tolist())) < 2 or not len(keys) or not sum(map(len, columns)):
        return None
    mean = y.mean()
    cut = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    col = np.concatenate(columns)
    rng = np.random.default_rng(seed)
    k = FACTORS
    theta = np.concatenate([np.zeros((len(keys), 1)), rng.normal(0, 0.02, (len(keys), k))], axis=1)
    bias = float(np.log(mean / (1 - mean)))
    m1, m2, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 512):
            some = order[lo : lo + 512]
            size = cut[some + 1] - cut[some]
            row = np.repeat(np.arange(len(some)), size)
            c = col[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cut[some], size)]
            stay = rng.random(len(c)) >= LEFT_OUT
            row, c = row[stay], c[stay]
            w, v = theta[c, 0], theta[c, 1:]
            s = np.stack([np.bincount(row, v[:, f], len(some)) for f in range(k)], 1)
            z = bias + np.bincount(row, w, len(some)) + 0.5 * (s**2).sum(1) - 0.5 * np.bincount(row, (v * v).sum(1), len(some))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            grad = np.zeros_like(theta)
            each = np.concatenate([g[row][:, None], g[row][:, None] * (s[row] - v)], 1)
            for f in range(k + 1):
                grad[:, f] = np.bincount(c, each[:, f], len(keys))
            grad += decay * theta / 10
            t += 1
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad**2
            theta -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            bias -= rate * 10 * g.sum()
    return Machine(keys, bias, theta[:, 0].copy(), theta[:, 1:].copy())


def sample_of(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> Stored:
    """(doc_id, text, y) of at most ``sample`` labelled ids."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded, so it may be broadcast
    return Stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "sample")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine | None:
    """Learns from at most ``sample`` ids of ``labels``; whoever calls decides which ones those may be. Of rows that share an id the least text counts.

    Terms are counted on the executors. The model takes those whose own rate of positive texts is ODD standard errors off the mean, and of the
    PAIR_TERMS commonest ones those that stand in a pair whose rate is PAIR_ODD off what the two alone make likely. The driver gets two bytes for each such term of a sampled text.
    """
    sampled = sample_of(docs, labels, label, sample)
    rows, positive = sampled.read().agg(F.count("y"), F.sum(F.least("y", F.lit(1)))).first()
    if not rows or not 0 < positive < rows:
        sampled.drop()
        return None

    def count(batches):
        for b in batches:
            for lo, hi, w in texts(b.column(0), MARKS):
                doc, bucket = _pairs(*terms(w))
                y = np.asarray(b.column(1)[lo:hi].to_numpy(), np.int64)[doc] > 0
                keys, at, n = np.unique(bucket, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.bincount(at, y, len(keys)).astype(np.int64))], ["bucket", "n", "pos"])

    counts = sampled.read().select("text", "y").mapInArrow(count, "bucket long, n long, pos long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counts = Stored(counts.where(F.col("n") >= MIN_DOCS), "terms")
    mean = positive / rows
    odd = F.abs(F.col("pos") - F.col("n") * mean) / F.sqrt(F.col("n") * (mean * (1 - mean)))
    top = lambda by, n: counts.read().withColumn("odd", odd).where(by > ODD if n == MODEL_TERMS else F.lit(True)).orderBy(F.desc(by), "bucket").limit(n).select("bucket").toArrow()["bucket"].to_numpy().astype(np.uint64)
    telling, common = np.sort(top(F.col("odd"), MODEL_TERMS)), np.sort(top(F.col("n"), PAIR_TERMS))
    counts.drop()
    keys = np.union1d(telling, common)

    def part(batches):
        for b in batches:
            for lo, hi, w in texts(b.column(0), MARKS):
                bucket, doc = terms(w)
                hit = member(bucket, keys)
                doc, bucket = _pairs(bucket[hit], doc[hit])
                at = np.searchsorted(keys, bucket).astype(np.uint16)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([pa.array([at[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()), b.column(1)[lo:hi], b.column(2)[lo:hi]], ["terms", "y", "doc_id"])

    table = sampled.read().select("text", "y", "doc_id").mapInArrow(part, f"terms binary, y int, doc_id {dict(docs.dtypes)['doc_id']}").toArrow().sort_by("doc_id")
    sampled.drop()
    columns, y = [np.frombuffer(t.as_buffer(), np.uint16) for chunk in table["terms"].chunks for t in chunk], (table["y"].to_numpy() > 0).astype(float)
    return select(keys, columns, y, telling, common)


def select(keys: np.ndarray, columns: list[np.ndarray], y: np.ndarray, telling: np.ndarray, common: np.ndarray) -> Machine | None:
    """Learns from the telling terms and those of the common ones that stand in a telling pair."""
    where = np.full(len(keys) + 1, -1)
    where[np.searchsorted(keys, common)] = np.arange(len(common))
    pick = lambda c: where[c][where[c] >= 0]
    stay = member(keys, telling)
    stay[np.searchsorted(keys, common)] |= paired([pick(c) for c in columns], y, len(common))
    place = (np.cumsum(stay) - 1).astype(np.uint16)
    return learn(keys[stay], [place[c[stay[c]]] for c in columns], y)


def score(docs: DataFrame, machine: Machine | None, text: bool = True) -> DataFrame:
    """``docs`` with score (0 to 1), and without their texts if ``text`` is false: those don't come back from the workers then."""
    docs = docs.drop("score", "predicted")
    names = [c for c in docs.columns if text or c != "text"]
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def part(batches):
        for b in batches:
            read = b.column(b.schema.get_field_index("text"))
            out = [model.value.score(w, hi - lo) if model.value else np.zeros(hi - lo) for lo, hi, w in texts(read, MARKS)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(np.concatenate(out) if out else [], pa.float64())], [*names, "score"])

    return docs.mapInArrow(part, docs.select(*names, F.lit(None).cast("double").alias("score")).schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: bool = True) -> DataFrame:
    """``docs`` with score and predicted, learnt from the labels that aren't held out; text as in score()."""
    machine = fit(docs, labels.where(~held_out()))
    return score(docs, machine, text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), text=False)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
