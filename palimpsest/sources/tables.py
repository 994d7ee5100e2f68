"""Memory, entity, edge and log tables made from the TPC-H-like test tables; the SQL runs in Spark and in other engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

T0, NOW, DIM = 1704067200, 1704117200, 64

MEMORY = f"""
SELECT d.lang AS agent_id, concat('m', lpad(CAST(d.doc_id AS VARCHAR(20)), 8, '0')) AS id,
       CASE d.doc_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' ELSE 'short_term' END AS layer,
       d.text AS content, CASE d.doc_id % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'consolidation' ELSE 'user' END AS source,
       CAST({T0} + (d.doc_id % 1000) * 60 AS BIGINT) AS valid_from,
       CASE WHEN d.doc_id % 7 = 0 THEN CAST({T0} + (d.doc_id % 1000) * 60 + 3600 * (1 + d.doc_id % 48) AS BIGINT) END AS valid_until,
       CAST(d.doc_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS importance,
       CAST({T0} + (d.doc_id % 1000) * 60 + 30 * (d.doc_id % 997) AS BIGINT) AS last_access, d.doc_id AS vec_id, e.embedding AS embedding
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

_ROW = "CAST({t} AS BIGINT) AS valid_from, {until} AS valid_until".format
_ID = "concat('{0}:', CAST({1} AS VARCHAR(20)))".format
_OPEN = "CAST(NULL AS BIGINT)"
ENTITY = " UNION ALL ".join(
    f"SELECT 'tpch' AS agent_id, {_ID(kind, key)} AS id, '{kind}' AS kind, {name} AS label, {_ROW(t=T0, until=until)} FROM {kind}"
    for kind, key, name, until in (("region", "r_regionkey", "r_name", _OPEN), ("nation", "n_nationkey", "n_name", _OPEN), ("supplier", "s_suppkey", "s_name", "CASE WHEN s_suppkey % 11 = 0 THEN CAST(1704110000 AS BIGINT) END"), ("customer", "c_custkey", "c_name", _OPEN), ("part", "p_partkey", "p_name", _OPEN))
)
EDGE = " UNION ALL ".join(
    f"SELECT {pre} 'tpch' AS agent_id, {_ID(*src)} AS src, '{rel}' AS relation, {_ID(*dst)} AS dst, CAST(1 AS DOUBLE) AS weight, {_ROW(t=T0, until=until)} FROM {table}"
    for table, pre, src, rel, dst, until in (
        ("nation", "", ("region", "n_regionkey"), "contains", ("nation", "n_nationkey"), _OPEN),
        ("nation", "", ("nation", "n_nationkey"), "in_region", ("region", "n_regionkey"), _OPEN),
        ("supplier", "", ("nation", "s_nationkey"), "hosts", ("supplier", "s_suppkey"), _OPEN),
        ("customer", "", ("nation", "c_nationkey"), "home_of", ("customer", "c_custkey"), "CASE WHEN c_custkey % 13 = 0 THEN CAST(1704110000 AS BIGINT) END"),
        ("orders", "", ("customer", "o_custkey"), "placed", ("order", "o_orderkey"), _OPEN),
        ("lineitem", "DISTINCT", ("order", "l_orderkey"), "includes", ("part", "l_partkey"), _OPEN),
    )
)
LOG = """
SELECT event_id AS seq, ts AS event_ts, concat('user', CAST(user_id AS VARCHAR(20))) AS agent_id,
       CASE event_type WHEN 'view' THEN 'put' WHEN 'click' THEN 'touch' WHEN 'signup' THEN 'importance' WHEN 'purchase' THEN 'invalidate' ELSE 'forget' END AS op,
       CASE event_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' ELSE 'short_term' END AS layer,
       concat('e', CAST(event_id % 500 AS VARCHAR(20))) AS id, value AS importance, CASE event_id % 5 WHEN 0 THEN 'consolidation' ELSE 'user' END AS source
FROM events"""
EPISODES = f"""
SELECT concat('conv', CAST(conv_id AS VARCHAR(20))) AS agent_id, concat(CAST(conv_id AS VARCHAR(20)), ':', CAST(turn AS VARCHAR(20))) AS id, 'episodic' AS layer, text AS content,
       CASE role WHEN 'user' THEN 'user' ELSE 'consolidation' END AS source, CAST({T0} + turn * 60 AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_until
FROM conversations"""
TABLES = {"memory": MEMORY, "entity": ENTITY, "edge": EDGE, "mutation_log": LOG, "episodes": EPISODES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES over the Parquet files of a folder."""
    import re

    sql = TABLES[name]
    for t in sorted(set(re.findall(r"(?:FROM|JOIN) (\w+)", sql))):
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}" if not re.search(rf"(?:FROM|JOIN) {t} [a-z]\b", sql) else rf"\1 {{{t}}}", sql)
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
