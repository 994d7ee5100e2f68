"""Entities, edges and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._stored import Stored, small
from ..functions.predicates import visible_at


def traverse(entity: DataFrame, edge: DataFrame, agent: str, start: str, depth: int, now: int) -> DataFrame:
    """(depth, id, kind, label) of what is reached over visible edges within ``depth`` hops, each at its least depth. Nodes without an entity or with an
    ended one are walked through and not returned; the start never is. Every front is stored, so a hop is one scan of the edges and one plan
    of two joins, however deep; an empty front ends the walk."""
    edges = edge.where((F.col("agent_id") == agent) & visible_at(now)).select("src", "dst")
    fronts = [Stored(edge.sparkSession.createDataFrame([(start, 0)], "id string, depth int"), "front")]
    seen = fronts[0].read()
    for d in range(1, depth + 1):
        last = fronts[-1].read().select(F.col("id").alias("src"))
        step = edges.join(small(last), "src").select(F.col("dst").alias("id")).distinct()
        fronts.append(Stored(step.join(small(seen.select("id")), "id", "left_anti").withColumn("depth", F.lit(d)), "front"))
        if fronts[-1].read().isEmpty():
            break
        seen = seen.unionByName(fronts[-1].read())
    here = entity.where((F.col("agent_id") == agent) & visible_at(now)).select("id", "kind", "label")
    out = Stored(here.join(small(seen.where("depth > 0")), "id").select("depth", "id", "kind", "label"), "reached")
    for done in fronts:
        done.drop()
    return out.read()


def of(rows: DataFrame, agent: str, **key: str) -> DataFrame:
    """One agent's entities or edges, all or those of a key: of(entity, a, id=...), of(edge, a, src=..., relation=..., dst=...), of(edge, a, src=...) for
    the edges that leave a node."""
    rows = rows.where(F.col("agent_id") == agent)
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows


def fold_entities(log: DataFrame) -> DataFrame:
    """The last upsert of each entity wins in all fields. log: seq and the fields."""
    rest = [c for c in log.columns if c not in ("agent_id", "id")]
    return log.groupBy("agent_id", "id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("agent_id", "id", *[f"r.{c}" for c in rest if c != "seq"])


def fold_edges(log: DataFrame) -> DataFrame:
    """A later upsert of an edge changes only its weight."""
    return log.groupBy("agent_id", "src", "relation", "dst").agg(
        F.max_by("weight", "seq").alias("weight"), F.min_by("valid_from", "seq").alias("valid_from"), F.min_by("valid_until", "seq").alias("valid_until")
    )


def dangling(entity: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges with an end that is no entity: agent_id, src, relation, dst, missing_src, missing_dst."""
    ids = entity.select("agent_id", "id").distinct()
    out = edge.select("agent_id", "src", "relation", "dst")
    for side in ("src", "dst"):
        known = ids.withColumnRenamed("id", side).withColumn(f"has_{side}", F.lit(True))
        out = out.join(known, ["agent_id", side], "left")
    out = out.withColumns({f"missing_{s}": F.col(f"has_{s}").isNull() for s in ("src", "dst")})
    return out.where("missing_src or missing_dst").select("agent_id", "src", "relation", "dst", "missing_src", "missing_dst")
