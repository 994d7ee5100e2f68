"""Export to and import from JSON lines: a header, memories by (valid_from, id), entities by id, edges by (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT, VERSION = "palimpsest-jsonl", 1
LINE = "type string, format string, version int, agent_id string, id string, layer string, content string, source string, valid_from bigint, valid_until bigint, importance double, last_access bigint, kind string, label string, src string, dst string, relation string, weight double"


def export_rows(memory: DataFrame, entity: DataFrame, edge: DataFrame, agent: str) -> DataFrame:
    """(part, k1, k2, k3, line): the lines and what they are sorted by. Ended rows are included, vectors aren't."""
    mine = lambda t: t.where(F.col("agent_id") == agent)
    line = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("type"), *cols))
    m = mine(memory).select(F.lit(1).alias("part"), F.col("valid_from").alias("n"), F.col("id").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), line("memory", "id", "layer", "content", "source", "valid_from", "valid_until", "importance", "last_access").alias("line"))
    e = mine(entity).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("n"), F.col("id").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), line("entity", "id", "kind", "label", "valid_from", "valid_until").alias("line"))
    g = mine(edge).select(F.lit(3).alias("part"), F.lit(0).cast("long").alias("n"), F.col("src").alias("k1"), F.col("dst").alias("k2"), F.col("relation").alias("k3"), line("edge", "src", "dst", "relation", "weight", "valid_from", "valid_until").alias("line"))
    return m.unionByName(e).unionByName(g)


def export_jsonl(memory: DataFrame, entity: DataFrame, edge: DataFrame, agent: str, path: str, now: int) -> None:
    """Writes text files whose order by name and line is the export's order."""
    spark = memory.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), *[F.lit("").alias(k) for k in ("k1", "k2", "k3")], F.to_json(F.struct(F.lit("header").alias("type"), F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(agent).alias("agent_id"), F.lit(now).alias("exported_at"))).alias("line"))
    head.unionByName(export_rows(memory, entity, edge, agent)).orderBy("part", "n", "k1", "k2", "k3").select("line").write.text(path)


def read_jsonl(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """Parsed lines with their place; everything is checked before anything is returned."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    rows = lines.select("at", F.from_json("value", LINE).alias("r")).select("at", "r.*")
    known = F.col("type").isin("header", "memory", "entity", "edge")
    c = rows.agg(F.count_if(F.col("type") == "header").alias("heads"), F.min("at").alias("first"), F.min(F.when(F.col("type") == "header", F.col("at"))).alias("head"), F.count_if(F.coalesce(~known, F.lit(True))).alias("bad"), F.count_if((F.col("type") == "header") & ((F.col("format") != FORMAT) | (F.col("version") != VERSION))).alias("other"), F.count_if(F.col("layer") == "procedural").alias("procedural")).first()
    if c["bad"] or c["heads"] != 1 or c["head"] != c["first"] or c["other"]:
        raise ValueError("not a valid export")
    if c["procedural"] and not trusted:
        raise ValueError("procedural memories are imported only if trusted")
    return rows


def import_memories(rows: DataFrame, existing: DataFrame, agent: str, order: str = "at") -> DataFrame:
    """Rows to be put: the first line of each id that isn't stored yet; their source is import, a missing importance 0."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("n = 1").drop("n")
    new = first.join(existing.where(F.col("agent_id") == agent).select("id").distinct(), "id", "left_anti")
    return new.withColumns({"agent_id": F.lit(agent), "source": F.lit("import"), "importance": F.coalesce("importance", F.lit(0.0)), "last_access": F.coalesce("last_access", "valid_from")})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One memory for each line that isn't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("content"))
