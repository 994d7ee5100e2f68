"""A stored inverted index: postings with the document's length, and each agent's statistics.

The postings are ordered by agent and term, so a search reads the row groups of its terms and no text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import QUERY_TOKENS
from .search import bm25_part, document_lengths, term_frequencies

POSTING = "agent_id string, term string, vec_id long, tf long, len long"
STATS = "agent_id string, doc_count long, total_terms long"


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, memory: DataFrame) -> Index:
        """Made anew from the memories (agent_id, vec_id, content)."""
        tf, lens = term_frequencies(memory), document_lengths(memory)
        rows = tf.join(lens, ["agent_id", "vec_id"]).select("agent_id", "term", "vec_id", "tf", "len")
        # by vec_id too, so that a common term of a large agent goes to several tasks
        rows.repartitionByRange("agent_id", "term", "vec_id").sortWithinPartitions("agent_id", "term", "vec_id").write.mode("overwrite").parquet(f"{self.path}/postings")
        lens.groupBy("agent_id").agg(F.count("*").alias("doc_count"), F.sum("len").alias("total_terms")).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(f"{self.path}/postings")

    def stats(self) -> DataFrame:
        return self.spark.read.schema(STATS).parquet(f"{self.path}/stats")

    def bm25(self, agent: str, terms: Iterable[str]) -> DataFrame:
        """(vec_id, score), as search.bm25: the first 32 terms, repeated ones count each time."""
        times = Counter(list(terms)[:QUERY_TOKENS])
        hits = self.postings().where((F.col("agent_id") == agent) & F.col("term").isin(*times)) if times else self.postings().limit(0)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most 32 rows
        stats = self.stats().where(F.col("agent_id") == agent).select(F.col("doc_count").alias("n"), (F.col("total_terms") / F.col("doc_count")).alias("mean"))
        weights = F.create_map(*[F.lit(x) for t in times.items() for x in t]) if times else F.create_map(F.lit(""), F.lit(0))
        part = weights[F.col("term")] * bm25_part(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("mean"))
        return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("vec_id").agg(F.sum(part).alias("score"))

    def top(self, agent: str, terms: Iterable[str], k: int) -> DataFrame:
        return self.bm25(agent, terms).orderBy(F.desc("score"), "vec_id").limit(k)

    def broken(self, memory: DataFrame) -> DataFrame:
        """(agent_id, vec_id, kind) where index and memories differ: a document whose postings don't add up to its length, or are none of any memory's, and
        agents (vec_id null) whose statistics are off."""
        key = ["agent_id", "vec_id"]
        sums = self.postings().groupBy(*key).agg(F.sum("tf").alias("sum"), F.max("len").alias("len"))
        both = document_lengths(memory).withColumnRenamed("len", "true").join(sums, key, "full_outer")
        kind = F.when(F.col("true").isNull(), "posting_without_memory").when(F.col("sum").isNull(), "memory_without_postings").when((F.col("sum") != F.col("true")) | (F.col("len") != F.col("true")), "wrong_counts")
        links = both.select(*key, kind.alias("kind")).where("kind is not null")
        true = document_lengths(memory).groupBy("agent_id").agg(F.struct(F.count("*").alias("doc_count"), F.sum("len").alias("total_terms")).alias("t"))
        stats = true.join(self.stats().select("agent_id", F.struct("doc_count", "total_terms").alias("s")), "agent_id", "full_outer")
        off = stats.where(~F.col("t").eqNullSafe(F.col("s"))).select("agent_id", F.lit(None).cast("long").alias("vec_id"), F.lit("wrong_statistics").alias("kind"))
        return links.unionByName(off)
