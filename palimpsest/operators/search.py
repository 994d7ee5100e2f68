"""Vector and keyword search, fusion of rankings, and recall.

A query vector is one row: it is fixed when a plan is made and goes into it as a literal. Filters come first and reach the scan; the top
k is one TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._stored import Stored, small
from ..functions import vector as V
from ..functions.predicates import recallable, similarity
from ..functions.text import spaced, term_count, token_count, tokens
from ..schema import BM25_B, BM25_K1, OVERSAMPLE, RRF_K, SIGNAL_DEPTH

#: Rows and queries of a block: 2 * 16 MB at 64 components.
ROWS, ASKS = 32_768, 16_384
FIELDS = ["id", "layer", "content", "source"]


def of_agent(table: DataFrame, agent: str) -> DataFrame:
    return table.where(F.col("agent_id") == agent)


def by_distance(memory: DataFrame, query: list[float]) -> DataFrame:
    """``memory`` with distance; rows without a vector of the query's length are left out."""
    fit = memory.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)))
    return fit.withColumn("distance", V.cosine_distance(F.col("embedding"), V.literal(query)))


def nearest(memory: DataFrame, agent: str, query: list[float], k: int, now: int, layer: str | None = None, with_procedural: bool = False) -> DataFrame:
    """The true top k among the rows that may be recalled."""
    return by_distance(of_agent(memory, agent).where(recallable(now, layer, with_procedural)), query).orderBy("distance", "vec_id").limit(k)


def nearest_oversampled(memory: DataFrame, agent: str, query: list[float], k: int, now: int, layer: str | None = None) -> DataFrame:
    """The store-wide top 8k first, filters after: fewer than k rows may be left."""
    top = by_distance(memory, query).orderBy("distance", "vec_id").limit(k * OVERSAMPLE)
    return of_agent(top, agent).where(recallable(now, layer)).orderBy("distance", "vec_id").limit(k)


def recall(memory: DataFrame, agent: str, query: list[float], k: int, now: int, layer: str | None = None, with_procedural: bool = False, exclude_imported: bool = False, metric: str = "cosine") -> DataFrame:
    """id, layer, content, source and score. Imported rows are dropped after the limit. Other metrics re-rank the cosine top 16k."""
    if metric == "cosine":
        top = nearest(memory, agent, query, k, now, layer, with_procedural).withColumn("score", similarity(F.col("distance")))
    else:
        other = {"euclidean": V.euclidean, "hamming": V.hamming}[metric]
        top = nearest(memory, agent, query, 16 * k, now, layer, with_procedural).withColumn("score", other(F.col("embedding"), V.literal(query))).orderBy("score", "vec_id").limit(k)
    if exclude_imported:
        top = top.where(F.col("source") != "import")
    return top.select(*FIELDS, "score")


def vector_ranking(memory: DataFrame, agent: str, query: list[float], k: int, now: int, with_procedural: bool = False) -> DataFrame:
    """(rank from 0, id)."""
    top = nearest(memory, agent, query, k, now, with_procedural=with_procedural).select("id", "distance", "vec_id")
    return top.select("id", (F.row_number().over(Window.orderBy("distance", "vec_id")) - 1).alias("rank"))  # at most k rows


def batch_nearest(memory: DataFrame, queries: DataFrame, k: int, now: int) -> DataFrame:
    """(agent_id, query_id, vec_id, distance, rank): the k nearest recallable rows of the query's own agent, itself left out; equal to 12 places is a tie.

    Each agent's queries (agent_id, vec_id, embedding) and rows, those of one length, are dealt over blocks; a task holds a block of either,
    multiplies them, and only a query's best k of a block are exchanged. A hot agent has more blocks, not larger ones.
    """
    rows = memory.where(recallable(now) & (F.size("embedding") > 0)).select("agent_id", "vec_id", F.size("embedding").alias("dim"), "embedding")
    asks = queries.where(F.size("embedding") > 0).select("agent_id", "vec_id", F.size("embedding").alias("dim"), "embedding")
    key = ["agent_id", "dim"]
    many = lambda t, size, name: t.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = Stored(many(rows, ROWS, "nr").join(many(asks, ASKS, "nq"), key), "blocks")
    of = lambda t: t.join(small(blocks.read()), key)
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = of(asks).select(*key, mine("nq").alias("q"), each("nr").alias("r"), "vec_id", "embedding")
    right = of(rows).select(*key, each("nq").alias("q"), mine("nr").alias("r"), "vec_id", "embedding")
    right = right.toDF(*right.columns)  # columns of its own where queries and memories are one table

    def block(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(asks) and len(rows):
            agent, (qi, q), (ids, x) = asks.column("agent_id")[0].as_py(), _vectors(asks), _vectors(rows)
            nx = np.sqrt((x * x).sum(1))
            for lo in range(0, len(qi), 64):
                some = q[lo : lo + 64]
                norm = np.sqrt((some * some).sum(1))[:, None] * nx
                d = np.where(norm <= V.TINY, 1.0, 1 - np.divide(some @ x.T, norm, out=np.zeros_like(norm), where=norm > V.TINY)).round(12)
                d[qi[lo : lo + 64, None] == ids[None]] = np.inf
                for i, row in zip(qi[lo : lo + 64], d, strict=True):
                    best = _least(row, ids, k) if len(row) > k else np.lexsort((ids, row))
                    best = best[np.isfinite(row[best])]
                    for c, v in zip(out, (np.full(len(best), i), ids[best], row[best]), strict=True):
                        c.append(v)
        agents = pa.array([agent] * sum(map(len, out[0])) if out[0] else [], pa.string())
        return pa.Table.from_arrays([agents, *(pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True))], ["agent_id", "query_id", "vec_id", "distance"])

    cell = [*key, "q", "r"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(block, "agent_id string, query_id long, vec_id long, distance double")
    w = Window.partitionBy("agent_id", "query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").chunks])
    return t.column("vec_id").to_numpy(), x.astype(float).reshape(len(t), -1)


def _least(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    edge = np.partition(row, k - 1)[k - 1]
    some = np.flatnonzero(row <= edge)
    return some[np.lexsort((ids[some], row[some]))[:k]]


# --- keywords ------------------------------------------------------------------------------------------------------


def term_frequencies(memory: DataFrame) -> DataFrame:
    """(agent_id, vec_id, term, tf)."""
    return memory.select("agent_id", "vec_id", F.explode(tokens("content")).alias("term")).groupBy("agent_id", "vec_id", "term").agg(F.count("*").alias("tf"))


def document_lengths(memory: DataFrame) -> DataFrame:
    """(agent_id, vec_id, len); documents without tokens aren't counted."""
    return memory.select("agent_id", "vec_id", token_count(spaced("content")).alias("len")).where("len > 0")


def corpus_statistics(memory: DataFrame) -> DataFrame:
    return document_lengths(memory).groupBy("agent_id").agg(F.count("*").alias("doc_count"), F.sum("len").alias("total_terms"))


def bm25(memory: DataFrame, agent: str, terms: Iterable[str], keep: list[str] | None = None) -> DataFrame:
    """vec_id, score and the columns of ``keep`` for the documents that hold a term. The agent's texts are read once; lengths and frequencies are
    stored, from which statistics and scores come. Statistics cover all the agent's documents, valid or not; repeated terms count each time.
    postings.Index answers the same without reading texts."""
    terms = list(terms)
    keep = keep or []
    one = list(dict.fromkeys(terms))
    row = F.col("_row")
    docs = of_agent(memory, agent).select("vec_id", *keep, spaced("content").alias("_row"))
    docs = docs.select("vec_id", *keep, token_count(row).alias("len"), *[term_count(row, w).alias(f"tf{i}") for i, w in enumerate(one)]).where("len > 0")
    docs = Stored(docs, "lengths").read()
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(one))])
    score: Column = F.lit(0.0)
    for w in terms:
        i = one.index(w)
        score = score + F.when(F.col(f"tf{i}") > 0, bm25_part(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("len"), F.col("n"), F.col("mean"))).otherwise(0.0)
    held = F.lit(False)
    for i in range(len(one)):
        held = held | (F.col(f"tf{i}") > 0)
    # one row of statistics
    return docs.where(held).crossJoin(F.broadcast(stats)).select("vec_id", *keep, score.alias("score"))


def bm25_part(tf: Column, df: Column, length: Column, n: Column, mean: Column) -> Column:
    """What one term adds to a document's score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def bm25_top(memory: DataFrame, agent: str, terms: Iterable[str], k: int) -> DataFrame:
    return bm25(memory, agent, terms).orderBy(F.desc("score"), "vec_id").limit(k)


def keyword_ranking(memory: DataFrame, agent: str, terms: Iterable[str], k: int, now: int, with_procedural: bool = False) -> DataFrame:
    """(rank from 0, id): the top 8k by BM25, then validity and layer, then k."""
    top = bm25(memory, agent, terms, ["id", "layer", "valid_from", "valid_until"]).orderBy(F.desc("score"), "vec_id").limit(OVERSAMPLE * k)
    kept = top.where(recallable(now, with_procedural=with_procedural)).orderBy(F.desc("score"), "vec_id").limit(k)
    return kept.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")) - 1).alias("rank"))


# --- fusion --------------------------------------------------------------------------------------------------------


def fuse(rankings: dict[str, DataFrame], k: float = RRF_K) -> DataFrame:
    """id, score, contributions: reciprocal ranks summed over signals, in the order of signals; best first, then by id."""
    every = None
    for i, (name, ranking) in enumerate(rankings.items()):
        part = ranking.select("id", "rank", F.lit(i).alias("i"), F.lit(name).alias("signal"))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.array_sort(F.collect_set(F.struct("i", "signal"))).alias("c"))
    return out.select("id", "score", F.col("c.signal").alias("contributions"))


def hydrate(ids: DataFrame, memory: DataFrame, agent: str) -> DataFrame:
    """``ids`` (id, pos) with what is stored for them, in order; unknown ids are dropped, validity isn't asked. ids are few (a top k)."""
    return of_agent(memory, agent).select(*FIELDS).join(F.broadcast(ids), "id").orderBy("pos")


def recall_hybrid(memory: DataFrame, agent: str, query: list[float], terms: Iterable[str], k: int, now: int, exclude_imported: bool = False) -> DataFrame:
    """Vector and keyword rankings of 4k each, fused; the top k with their rows, best first."""
    rankings = {"vector": vector_ranking(memory, agent, query, SIGNAL_DEPTH * k, now)}
    terms = list(terms)
    if terms:
        rankings["keyword"] = keyword_ranking(memory, agent, terms, SIGNAL_DEPTH * k, now)
    top = fuse(rankings).orderBy(F.desc("score"), "id").limit(k)
    top = top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)  # at most k rows
    out = hydrate(top, memory, agent)
    if exclude_imported:
        out = out.where(F.col("source") != "import")
    return out.select("pos", *FIELDS, "score", "contributions")


def search_graph(memory: DataFrame, entity: DataFrame, agent: str, query: list[float], label: str, k: int, now: int) -> DataFrame:
    """Recall among memories that mention an entity whose label contains ``label`` (case counts): the nearest 8k, then the filter, then k."""
    top = nearest(memory, agent, query, OVERSAMPLE * k, now).withColumn("score", similarity(F.col("distance")))
    named = of_agent(entity, agent).where((F.col("valid_until").isNull() | (F.col("valid_until") > now)) & F.col("label").contains(label)).select("label").distinct()
    return top.join(named, F.col("content").contains(F.col("label")), "left_semi").orderBy("distance", "vec_id").limit(k).select(*FIELDS, "score")
