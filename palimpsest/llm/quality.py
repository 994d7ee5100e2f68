"""Quality: importance resampling. Hashed n-gram models of target text and of raw text; a document's weight is the ratio of its probabilities
under the two, and a sample without replacement is drawn by Gumbel top-k: the k largest of log weight plus Gumbel noise.

Features are words, pairs of words, runs of marks, pairs of these, and words that repeat the one before, hashed to ``BUCKETS``. Raw counts come from all documents;
target counts from the documents that a bounded sample of labels marks as good. Noise follows from id and seed, so a run can be repeated.

Nulls and empty texts have a log weight of 0. Ties at the boundary go to the smaller id, then to the lesser text; repeated rows and rows without an id each count as a row, with equal keys where id and text are equal. Columns named log_weight or gumbel_key are replaced. Without labels all log weights are 0. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import MARKS, mix, stored, texts

BUCKETS = 1 << 16
#: Labelled rows that the target model may take, at most; part of the documents that is drawn; seed of the noise.
SAMPLE, SHARE, SEED = 50_000, 0.8, 11
RUNS = ~MARKS | np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def features(column: pa.Array):
    """(from row, to row, bucket, text) of all features, repeated as they occur."""
    for (lo, hi, w), (_, _, r) in zip(texts(column, MARKS), texts(column, RUNS), strict=True):
        h, doc = [], []
        for kind, t in ((1, w), (2, r)):
            salt = mix(np.array([kind], np.uint64) << np.uint64(40))
            two, at = t.shingles(2)
            h += [t.hash ^ salt, two ^ salt]
            doc += [t.doc, t.doc[at]]
        again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        h.append(np.full(len(again), 12345, np.uint64))
        doc.append(w.doc[again])
        yield lo, hi, (mix(np.concatenate(h)) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(doc)


def models(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """For each bucket the logarithm of its probability under the target model less that under the raw one; add-one smoothing."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded, so it may be broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"))

    def count(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, bucket, doc in features(b.column(0)):
                n[0] += np.bincount(bucket, minlength=BUCKETS)
                n[1] += np.bincount(bucket[good[lo:hi][doc]], minlength=BUCKETS)
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], ["bucket", "raw", "target"])

    n = np.ones((2, BUCKETS))
    for r in marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        n[:, r["bucket"]] += r["raw"], r["target"]
    p = np.log(n / n.sum(1, keepdims=True))
    return p[1] - p[0] if n[1].sum() > BUCKETS else np.zeros(BUCKETS)


def weighed(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """``docs`` with log_weight and gumbel_key."""
    docs = docs.drop("log_weight", "gumbel_key")
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def part(batches):
        for b in batches:
            out = [np.bincount(doc, model.value[bucket], hi - lo) for lo, hi, bucket, doc in features(b.column(b.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*b.schema.names, "log_weight"])

    out = docs.mapInArrow(part, docs.selectExpr("*", "cast(null as double) log_weight").schema)
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return out.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))


def kth(keys: DataFrame, column: str, k: int, parts: int = 1024, few: int = 1000) -> float | None:
    """The k-th largest value of a column, by counting in ever narrower intervals. keys: a stored table."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 0 < k <= n:
        return None
    while True:
        inside = keys.where(F.col(column).between(lo, hi))
        part = F.least(F.floor((F.col(column) - lo) / (hi - lo) * parts), F.lit(parts - 1)) if hi > lo else F.lit(0)
        rows = sorted(inside.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["p"])
        for r in rows:
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"]
        if r["n"] <= few:
            return sorted((x[0] for x in keys.where(F.col(column).between(r["lo"], r["hi"])).select(column).collect()), reverse=True)[k - 1]
        lo, hi = r["lo"], r["hi"]


def sampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows drawn (a share of all rows), with all their columns, log_weight and gumbel_key; the weights of the rows drawn are made anew from the texts."""
    out = weighed(docs, models(docs, labels), seed)
    keys = stored(out.select("doc_id", "gumbel_key"), "keys")
    k = round(share * keys.count())
    at = kth(keys, "gumbel_key", k)
    if at is None:
        return out.where("false")
    over, tied = keys.agg(F.count_if(F.col("gumbel_key") > at), F.count_if(F.col("gumbel_key") == at)).first()
    if over + tied == k:
        return out.where(F.col("gumbel_key") >= at)
    # of the rows at the boundary as many as fit, by id and text
    last = out.where(F.col("gumbel_key") == at).orderBy("doc_id", "text").limit(k - over)
    return out.where(F.col("gumbel_key") > at).unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")).select("doc_id", "log_weight", "gumbel_key")
