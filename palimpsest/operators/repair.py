"""What is wrong with a store's tables, what mends it, and the mending of what is derived."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, memories
from .postings import Index

#: What each kind calls for; a kind that isn't listed puts memories themselves at risk.
ACTIONS = {
    "missing_vector": ("reembed_missing",),
    "wrong_dimension": ("reembed_missing",),
    "stale_allocator": ("reset_allocator",),
    "posting_without_memory": ("rebuild_index",),
    "memory_without_postings": ("rebuild_index",),
    "wrong_counts": ("rebuild_index",),
    "wrong_statistics": ("rebuild_index",),
}
WARNINGS = ("dangling_edge",)


def issues(memory: DataFrame, dim: int, next_vec_id: int | None = None, index: Index | None = None, entity: DataFrame | None = None, edge: DataFrame | None = None) -> DataFrame:
    """(severity, kind, agent_id, detail): detail names the row. What isn't given isn't checked."""
    row = lambda t, kind, detail, severity="error": t.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind, "agent_id", detail.cast("string").alias("detail"))
    out = row(memories.missing_vectors(memory), "missing_vector", F.col("id"))
    out = out.unionByName(row(memories.wrong_dimensions(memory, dim), "wrong_dimension", F.col("id")))
    twice = lambda *key: memory.groupBy(*key).agg(F.count("*").alias("n"), F.min("agent_id").alias("_a")).where("n > 1")
    out = out.unionByName(row(twice("agent_id", "id"), "repeated_id", F.col("id"))).unionByName(row(twice("vec_id").withColumnRenamed("_a", "agent_id"), "repeated_vector_id", F.col("vec_id")))
    if next_vec_id is not None:
        out = out.unionByName(row(memory.where(F.col("vec_id") >= next_vec_id), "stale_allocator", F.col("vec_id")))
    if index is not None:
        out = out.unionByName(row(index.broken(memory), F.col("kind"), F.col("vec_id")))
    if entity is not None and edge is not None:
        out = out.unionByName(row(graph.dangling(entity, edge), "dangling_edge", F.concat_ws(" ", "src", "relation", "dst"), "warning"))
    return out


def plan(kinds: Iterable[str]) -> dict[str, list[str]]:
    """From kinds of issues: the actions that mend them, warnings, and what no action mends."""
    kinds = list(dict.fromkeys(kinds))
    return {
        "actions": list(dict.fromkeys(a for k in kinds for a in ACTIONS.get(k, ()))),
        "warnings": [k for k in kinds if k in WARNINGS],
        "at_risk": [k for k in kinds if k not in ACTIONS and k not in WARNINGS],
    }


def rebuild(memory: DataFrame, index: Index) -> tuple[Index, DataFrame]:
    """The index made anew, and the memories that need a vector. No memory is changed; a second call gives the same."""
    return index.build(memory), memories.missing_vectors(memory)
