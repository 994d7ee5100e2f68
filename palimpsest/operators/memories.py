"""Listing, statistics, retention and checks over the memory table. Every function takes the time it should count as now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import expired_at, retention_score, valid_at
from ..schema import FACT_COSINE, LAYERS
from .search import batch_nearest, by_distance, of_agent


def list_memories(memory: DataFrame, agent: str, limit: int, now: int, layer: str | None = None, include_invalid: bool = False) -> DataFrame:
    rows = of_agent(memory, agent)
    if not include_invalid:
        rows = rows.where(valid_at(now))
    if layer:
        rows = rows.where(F.col("layer") == layer)
    return rows.orderBy(F.desc("valid_from"), "id").limit(limit)


def get(memory: DataFrame, agent: str, ident: str) -> DataFrame:
    """The memory of an id, valid or not; no row if there is none."""
    return of_agent(memory, agent).where(F.col("id") == ident)


def layer_of(memory: DataFrame, agent: str, ident: str) -> DataFrame:
    return get(memory, agent, ident).select("layer")


def resolve(memory: DataFrame, vec_ids: DataFrame) -> DataFrame:
    """``vec_ids`` (vec_id) with agent_id and id; nulls where no memory has the vector."""
    return vec_ids.join(memory.select("vec_id", "agent_id", "id"), "vec_id", "left")


def scan(memory: DataFrame, agent: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """An agent's memories by id, from ``start`` up to but not with ``end``."""
    rows = of_agent(memory, agent)
    if start is not None:
        rows = rows.where(F.col("id") >= start)
    if end is not None:
        rows = rows.where(F.col("id") < end)
    return rows.orderBy("id")


def page(memory: DataFrame, agent: str, after: str | None, limit: int) -> DataFrame:
    """The next rows by id; fewer than ``limit`` mean the end."""
    rows = of_agent(memory, agent)
    return (rows.where(F.col("id") > after) if after is not None else rows).orderBy("id").limit(limit)


def recent_episodes(memory: DataFrame, agent: str, limit: int, now: int) -> DataFrame:
    return list_memories(memory, agent, limit, now, "episodic").select("id", "content", "valid_from")


def fact_exists(memory: DataFrame, agent: str, contents: DataFrame, now: int) -> DataFrame:
    """``contents`` (content) with known: whether a valid semantic memory says exactly this."""
    facts = of_agent(memory, agent).where(valid_at(now) & (F.col("layer") == "semantic")).select("content", F.lit(True).alias("k")).distinct()
    return contents.join(facts, "content", "left").select("content", F.coalesce("k", F.lit(False)).alias("known"))


def fact_known(memory: DataFrame, agent: str, content: str, vector: list[float] | None, now: int) -> bool:
    """An equal valid fact, or the nearest one at a cosine of 0.95 or more."""
    facts = of_agent(memory, agent).where(valid_at(now) & (F.col("layer") == "semantic"))
    if facts.where(F.col("content") == content).limit(1).count():
        return True
    near = by_distance(facts, vector).orderBy("distance", "vec_id").limit(1).select("distance").collect() if vector else []
    return bool(near) and 1 - near[0][0] >= FACT_COSINE


def facts_known(memory: DataFrame, facts: DataFrame, now: int) -> DataFrame:
    """``facts`` (agent_id, vec_id, content, embedding) as (agent_id, vec_id, known): an equal valid fact of the agent, or a nearest one, the row itself aside, at a cosine of 0.95 or more."""
    held = memory.where(valid_at(now) & (F.col("layer") == "semantic"))
    equal = facts.join(held.select("agent_id", "content").distinct(), ["agent_id", "content"], "left_semi").select("agent_id", "vec_id")
    near = batch_nearest(held, facts, 1, now).where(1 - F.col("distance") >= FACT_COSINE).select("agent_id", F.col("query_id").alias("vec_id"))
    known = equal.unionByName(near).distinct().withColumn("known", F.lit(True))
    return facts.select("agent_id", "vec_id").join(known, ["agent_id", "vec_id"], "left").select("agent_id", "vec_id", F.coalesce("known", F.lit(False)).alias("known"))


def agent_stats(memory: DataFrame, now: int) -> DataFrame:
    """Valid memories of each agent, by layer and in all."""
    counts = [F.count_if(F.col("layer") == name).alias(name) for name in LAYERS]
    return memory.where(valid_at(now)).groupBy("agent_id").agg(*counts, F.count_if(F.col("layer").isin(*LAYERS)).alias("total"))


def candidates_page(memory: DataFrame, now: int, agent: str, after: str | None, limit: int) -> DataFrame:
    """The next candidates of an agent by id; fewer than ``limit`` mean the end."""
    rows = of_agent(forget_candidates(memory, now), agent)
    return (rows.where(F.col("id") > after) if after is not None else rows).orderBy("id").limit(limit)


def expired(memory: DataFrame, now: int, agent: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """(agent_id, id, valid_until) of ended memories."""
    rows = memory.where(expired_at(now)).select("agent_id", "id", "valid_until")
    if agent is not None:
        rows = of_agent(rows, agent)
    if after is not None:
        rows = rows.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def expired_report(memory: DataFrame, now: int, page_size: int) -> DataFrame:
    """(agent_id, examined, pages) a collection of ended memories would take."""
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    return expired(memory, now).groupBy("agent_id").agg(F.count("*").alias("examined")).withColumn("pages", F.ceil(F.col("examined") / page_size).cast("long"))


def forget_candidates(memory: DataFrame, now: int) -> DataFrame:
    return memory.where(valid_at(now)).select("agent_id", "id", "importance", "last_access")


def retention(memory: DataFrame, capacity: int, half_life: float, now: int) -> DataFrame:
    """Candidates with score, rank (from 1, in the agent) and keep. Only survivors are ranked: the window's group limit keeps the top ``capacity`` of each partition."""
    scored = forget_candidates(memory, now).withColumn("score", retention_score(now, half_life))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("score"), "id")))
    return ranked


def survivors(memory: DataFrame, capacity: int, half_life: float, now: int) -> DataFrame:
    return retention(memory, capacity, half_life, now).where(F.col("rank") <= capacity)


def victims(memory: DataFrame, capacity: int, half_life: float, now: int) -> DataFrame:
    """Candidates that aren't survivors."""
    return forget_candidates(memory, now).join(survivors(memory, capacity, half_life, now).select("agent_id", "id"), ["agent_id", "id"], "left_anti")


def forgetting_report(memory: DataFrame, capacity: int, now: int) -> DataFrame:
    out = forget_candidates(memory, now).groupBy("agent_id").agg(F.count("*").alias("scanned"))
    return out.withColumn("evicted", F.greatest(F.lit(0), F.col("scanned") - capacity))


def fit_bytes(rows: DataFrame, order: list, cap: int, columns: list[str]) -> DataFrame:
    """The first rows whose JSON fits ``cap`` bytes, with what they add up to. rows: a bounded result, as of a recall."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes_so_far", F.sum(F.octet_length(F.to_json(F.struct(*columns)))).over(w)).where(F.col("bytes_so_far") <= cap)


def missing_vectors(memory: DataFrame) -> DataFrame:
    return memory.where("embedding is null").select("agent_id", "id", "vec_id")


def wrong_dimensions(memory: DataFrame, dim: int) -> DataFrame:
    return memory.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).select("agent_id", "id", F.size("embedding").alias("dim"))


def next_vec_id(memory: DataFrame) -> DataFrame:
    return memory.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("next_vec_id"))
