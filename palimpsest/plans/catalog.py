"""Queries over the test tables, one or more for each operator, and the same in plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .._stored import shared_dir
from ..functions.embed import ByteEmbedder, embedded
from ..functions.predicates import similarity, trust, valid_at
from ..functions.text import FROM, TO, tokens
from ..operators import graph as G
from ..operators import memories as M
from ..operators import repair as R
from ..operators import search as S
from ..operators.postings import Index
from ..sources import porting as P
from ..sources.tables import DIM, NOW, TABLES, table
from ..streaming import events as E

K, AGENT, PROBE = 10, "en", 7
TERMS = ["the", "of", "worthless", "the"]
HALF_LIFE, CAPACITY = 86_400.0, 25
QUERIES, SQL = {}, {}


def query(sql: str | None = None, *uses: str):
    """Registers a function of (table getter) and its SQL; ``uses`` are the tables that the SQL needs in front of it."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: table(spark, sf_dir, name) if name in TABLES else spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = _with(uses) + sql
        return f

    return add


def _with(uses: tuple[str, ...]) -> str:
    parts = [f"{u} AS ({TABLES[u] if u in TABLES else _VIEWS[u]})" for u in uses]
    return "WITH RECURSIVE " + ", ".join(parts) + " " if parts else ""


def probe(t) -> list[float]:
    """The probe's vector: one row."""
    return list(t("embeddings").where(F.col("vec_id") == PROBE).select("embedding").first()[0])


def r6(c: str):
    return F.round(c, 6).alias(c)


_VALID = f"valid_from <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until)"
_OPEN = f"(valid_until IS NULL OR {NOW} < valid_until)"
_VIEWS = {
    "q": f"SELECT CAST(embedding AS DOUBLE[]) v FROM embeddings WHERE vec_id = {PROBE}",
    "dist": "SELECT m.*, CAST(embedding AS DOUBLE[]) e, v, list_cosine_distance(CAST(embedding AS DOUBLE[]), v) distance FROM memory m, q WHERE embedding IS NOT NULL",
    "fit": f"SELECT * FROM dist WHERE agent_id = '{AGENT}' AND layer <> 'procedural' AND {_VALID}",
    "tok": f"SELECT agent_id, vec_id, id, layer, valid_from, valid_until, list_transform(list_filter(string_split_regex(content, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: translate(lower(x), '{FROM}', '{TO}')) t FROM memory",
    "bm": "SELECT t0.vec_id, t0.id, t0.layer, t0.valid_from, t0.valid_until, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t0.t) / mean))) score "
    f"FROM (SELECT * FROM tok WHERE agent_id = '{AGENT}' AND len(t) > 0) t0, (SELECT count(*) n, avg(len(t)) mean FROM tok WHERE agent_id = '{AGENT}' AND len(t) > 0) s, "
    f"(SELECT vec_id, x, count(*) tf FROM (SELECT vec_id, unnest(t) x FROM tok WHERE agent_id = '{AGENT}') GROUP BY ALL) f, "
    f"(SELECT x, count(DISTINCT vec_id) df FROM (SELECT vec_id, unnest(t) x FROM tok WHERE agent_id = '{AGENT}') GROUP BY x) g, (SELECT unnest({TERMS}) x) q "
    "WHERE f.vec_id = t0.vec_id AND g.x = f.x AND q.x = f.x GROUP BY ALL",
    "vrank": f"SELECT id, row_number() OVER (ORDER BY distance, vec_id) - 1 rank FROM fit QUALIFY rank < {4 * K}",
    "krank": f"SELECT id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 rank FROM (SELECT * FROM bm ORDER BY score DESC, vec_id LIMIT {8 * 4 * K}) WHERE layer <> 'procedural' AND {_VALID} QUALIFY rank < {4 * K}",
    "fused": "SELECT id, sum(1 / (60.0 + rank)) score, array_to_string(list(s ORDER BY i), ',') contributions FROM (SELECT id, rank, 0 i, 'vector' s FROM vrank UNION ALL SELECT id, rank, 1, 'keyword' FROM krank) GROUP BY id",
    "active": f"SELECT agent_id, id, importance, last_access FROM memory WHERE {_VALID}",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY importance + {HALF_LIFE} / ({HALF_LIFE} + greatest(0, {NOW} - last_access)) DESC, id) rank FROM active",
}
_REC = "id, layer, source, round(greatest(0, least(1, 1 - distance)), 6) score"
_VEC = ("memory", "q", "dist", "fit")


def _recalled(df: DataFrame) -> DataFrame:
    return df.select("id", "layer", "source", r6("score"))


@query(f"SELECT {_REC} FROM fit ORDER BY distance, vec_id LIMIT {K}", *_VEC)
def recall_vector_exact(t):
    return _recalled(S.recall(t("memory"), AGENT, probe(t), K, NOW))


@query(f"SELECT {_REC} FROM (SELECT * FROM dist ORDER BY distance, vec_id LIMIT {8 * K}) WHERE agent_id = '{AGENT}' AND layer <> 'procedural' AND {_VALID} ORDER BY distance, vec_id LIMIT {K}", *_VEC)
def recall_vector_oversampled(t):
    return _recalled(S.nearest_oversampled(t("memory"), AGENT, probe(t), K, NOW).withColumn("score", similarity(F.col("distance"))))


@query(f"SELECT {_REC} FROM dist WHERE agent_id = '{AGENT}' AND layer = 'procedural' AND {_VALID} ORDER BY distance, vec_id LIMIT {K}", *_VEC)
def recall_by_layer(t):
    return _recalled(S.recall(t("memory"), AGENT, probe(t), K, NOW, layer="procedural"))


@query(f"SELECT * FROM (SELECT {_REC} FROM fit ORDER BY distance, vec_id LIMIT {K}) WHERE source <> 'import'", *_VEC)
def recall_exclude_imported(t):
    return _recalled(S.recall(t("memory"), AGENT, probe(t), K, NOW, exclude_imported=True))


@query(f"SELECT id, layer, source, round(list_distance(e, v), 6) score FROM (SELECT * FROM fit ORDER BY distance, vec_id LIMIT {16 * K}) ORDER BY list_distance(e, v), vec_id LIMIT {K}", *_VEC)
def metric_euclidean_rerank(t):
    return _recalled(S.recall(t("memory"), AGENT, probe(t), K, NOW, metric="euclidean"))


@query(f"SELECT id, layer, source, CAST(h AS DOUBLE) score FROM (SELECT *, len(list_filter(list_zip(e, v), lambda z: (z[1] >= 0) <> (z[2] >= 0))) h FROM (SELECT * FROM fit ORDER BY distance, vec_id LIMIT {16 * K})) ORDER BY h, vec_id LIMIT {K}", *_VEC)
def metric_hamming_rerank(t):
    return _recalled(S.recall(t("memory"), AGENT, probe(t), K, NOW, metric="hamming"))


@query(f"SELECT id, CAST(rank AS INTEGER) rank FROM vrank WHERE rank < {K}", *_VEC, "vrank")
def vector_ranking_ids(t):
    return S.vector_ranking(t("memory"), AGENT, probe(t), K, NOW)


@query(f"SELECT agent_id, query_id, vec_id, round(d, 6) distance, CAST(rank AS INTEGER) rank FROM (SELECT a.agent_id, a.vec_id query_id, b.vec_id, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) d, row_number() OVER (PARTITION BY a.agent_id, a.vec_id ORDER BY list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) rank FROM memory a JOIN memory b ON a.agent_id = b.agent_id AND a.vec_id <> b.vec_id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.layer <> 'procedural' AND b.valid_from <= {NOW} AND (b.valid_until IS NULL OR {NOW} < b.valid_until)) WHERE rank <= 5", "memory")
def batch_knn(t):
    m = t("memory")
    return S.batch_nearest(m, m, 5, NOW).select("agent_id", "query_id", "vec_id", r6("distance"), "rank")


@query("SELECT agent_id, x AS term, CAST(count(*) AS BIGINT) total_tf, CAST(count(DISTINCT vec_id) AS BIGINT) df FROM (SELECT agent_id, vec_id, unnest(t) x FROM tok) GROUP BY ALL", "memory", "tok")
def tokenize_terms(t):
    return S.term_frequencies(t("memory")).groupBy("agent_id", "term").agg(F.sum("tf").alias("total_tf"), F.count("*").alias("df"))


@query("SELECT agent_id, vec_id, CAST(len(t) AS BIGINT) len FROM tok WHERE len(t) > 0", "memory", "tok")
def doc_length(t):
    return S.document_lengths(t("memory"))


@query("SELECT agent_id, CAST(count(*) AS BIGINT) doc_count, CAST(sum(len(t)) AS BIGINT) total_terms FROM tok WHERE len(t) > 0 GROUP BY agent_id", "memory", "tok")
def fts_stats(t):
    return S.corpus_statistics(t("memory"))


@query("SELECT agent_id, x AS term, CAST(count(DISTINCT vec_id) AS BIGINT) df FROM (SELECT agent_id, vec_id, unnest(t) x FROM tok) WHERE x IN ('the', 'le', 'der', 'of') GROUP BY ALL", "memory", "tok")
def doc_frequency(t):
    words = ["the", "le", "der", "of"]
    held = t("memory").select("agent_id", F.explode(F.array_intersect(tokens("content"), F.array(*map(F.lit, words)))).alias("term"))
    return held.groupBy("agent_id", "term").agg(F.count("*").alias("df"))


_KEY = ("memory", "tok", "bm")


@query(f"SELECT vec_id, round(score, 6) score FROM bm ORDER BY bm.score DESC, vec_id LIMIT {2 * K}", *_KEY)
def bm25_topk(t):
    return S.bm25_top(t("memory"), AGENT, TERMS, 2 * K).select("vec_id", r6("score"))


@query(f"SELECT id, CAST(rank AS INTEGER) rank FROM krank WHERE rank < {4 * K}", *_KEY, "krank")
def keyword_ranking_ids(t):
    return S.keyword_ranking(t("memory"), AGENT, TERMS, 4 * K, NOW)


_HYBRID = (*_VEC, "tok", "bm", "vrank", "krank", "fused")


@query("SELECT id, round(score, 6) score, contributions FROM fused", *_HYBRID)
def rrf_fuse(t):
    m = t("memory")
    f = S.fuse({"vector": S.vector_ranking(m, AGENT, probe(t), 4 * K, NOW), "keyword": S.keyword_ranking(m, AGENT, TERMS, 4 * K, NOW)})
    return f.select("id", r6("score"), F.array_join("contributions", ",").alias("contributions"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY f.score DESC, id) - 1 AS INTEGER) pos, id, layer, source, round(f.score, 6) score, contributions FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT {K}) f JOIN memory USING (id)", *_HYBRID)
def recall_hybrid(t):
    return S.recall_hybrid(t("memory"), AGENT, probe(t), TERMS, K, NOW).select("pos", "id", "layer", "source", r6("score"), F.array_join("contributions", ",").alias("contributions"))


@query("SELECT pos, id, layer, source FROM (SELECT CAST(generate_subscripts(['m00000014', 'none', 'm00000002', 'm00000001', 'm00000021'], 1) - 1 AS INTEGER) pos, unnest(['m00000014', 'none', 'm00000002', 'm00000001', 'm00000021']) id) JOIN memory USING (id) WHERE agent_id = 'en'", "memory")
def hydrate_ordered(t):
    m = t("memory")
    ids = m.sparkSession.createDataFrame(list(enumerate(["m00000014", "none", "m00000002", "m00000001", "m00000021"])), "pos int, id string")
    return S.hydrate(ids, m, AGENT).select("pos", "id", "layer", "source")


_LABELS = ("SELECT 'en' AS agent_id, concat('l', n_nationkey) AS id, 'word' AS kind, lower(substr(n_name, 1, 3)) AS label, CAST(1 AS BIGINT) AS valid_from, CASE WHEN n_nationkey % 3 = 0 THEN CAST(2 AS BIGINT) END AS valid_until FROM nation",)[0]


@query(f"SELECT {_REC} FROM (SELECT * FROM fit ORDER BY distance, vec_id LIMIT {8 * K}) f WHERE EXISTS (SELECT 1 FROM ({_LABELS}) l WHERE {_OPEN.replace('valid_until', 'l.valid_until')} AND contains(l.label, 'a') AND contains(f.content, l.label)) ORDER BY distance, vec_id LIMIT {K}", *_VEC)
def search_graph(t):
    n = t("nation")
    labels = n.select(F.lit("en").alias("agent_id"), F.lower(F.substring("n_name", 1, 3)).alias("label"), F.when(F.col("n_nationkey") % 3 == 0, 2).cast("long").alias("valid_until"))
    return _recalled(S.search_graph(t("memory"), labels, AGENT, probe(t), "a", K, NOW))


def _walk(start: str, depth: int) -> str:
    return f", w AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN edge e ON e.src = w.id WHERE w.depth < {depth} AND {_OPEN.replace('valid_until', 'e.valid_until')}) SELECT min(depth) AS depth, w.id, kind, label FROM w JOIN entity n ON n.id = w.id WHERE {_OPEN.replace('valid_until', 'n.valid_until')} GROUP BY w.id, kind, label HAVING w.id <> '{start}'"


def _graph(name: str, start: str, depth: int) -> None:
    def f(t):
        return G.traverse(t("entity"), t("edge"), "tpch", start, depth, NOW)

    f.__name__ = name
    query("", "entity", "edge")(f)
    SQL[name] = _with(("entity", "edge")).rstrip() + _walk(start, depth)


for _n, _s, _d in (("graph_traverse_d1", "region:1", 1), ("graph_traverse_d2", "region:1", 2), ("graph_traverse_d3", "region:1", 3), ("graph_through_missing", "customer:1", 2), ("graph_traverse_d10", "region:1", 10), ("graph_cycle", "nation:3", 2)):
    _graph(_n, _s, _d)


@query("SELECT agent_id, id, arg_max(layer, seq) layer, arg_max(importance, seq) importance FROM mutation_log GROUP BY agent_id, id", "mutation_log")
def entity_fold(t):
    return G.fold_entities(t("mutation_log").select("seq", "agent_id", "id", "layer", "importance"))


@query("SELECT 'tpch' AS agent_id, concat('u', user_id) src, event_type relation, concat('e', event_id % 500) dst, arg_max(value, event_id) weight, min(event_id) valid_from, CAST(NULL AS BIGINT) valid_until FROM events GROUP BY ALL")
def edge_fold(t):
    e = t("events").select(F.lit("tpch").alias("agent_id"), F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("relation"), F.concat(F.lit("e"), F.col("event_id") % 500).alias("dst"), F.col("value").alias("weight"), F.col("event_id").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"), F.col("event_id").alias("seq"))
    return G.fold_edges(e)


@query("SELECT agent_id, " + ", ".join(f"CAST(count(*) FILTER (layer = '{x}') AS BIGINT) {x}" for x in ("short_term", "episodic", "procedural", "semantic")) + f", CAST(count(*) AS BIGINT) total FROM memory WHERE {_VALID} GROUP BY agent_id", "memory")
def agent_stats(t):
    return M.agent_stats(t("memory"), NOW)


_LIST = "id, layer, source, valid_from, valid_until"


@query(f"SELECT {_LIST} FROM memory WHERE agent_id = '{AGENT}' AND {_VALID} ORDER BY valid_from DESC, id LIMIT 50", "memory")
def list_memories(t):
    return M.list_memories(t("memory"), AGENT, 50, NOW).select(*_LIST.split(", "))


@query(f"SELECT {_LIST} FROM memory WHERE agent_id = '{AGENT}' AND id > 'm00000100' ORDER BY id LIMIT 50", "memory")
def list_page_keyset(t):
    return M.page(t("memory"), AGENT, "m00000100", 50).select(*_LIST.split(", "))


@query(f"SELECT id, content, valid_from FROM memory WHERE agent_id = '{AGENT}' AND layer = 'episodic' AND {_VALID} ORDER BY valid_from DESC, id LIMIT 50", "memory")
def recent_episodes(t):
    return M.recent_episodes(t("memory"), AGENT, 50, NOW)


@query(f"SELECT md5(content) h, content IN (SELECT content FROM memory WHERE agent_id = '{AGENT}' AND layer = 'semantic' AND {_VALID}) known FROM (SELECT DISTINCT content FROM memory)", "memory")
def exact_fact_exists(t):
    m = t("memory")
    return M.fact_exists(m, AGENT, m.select("content").distinct(), NOW).select(F.md5("content").alias("h"), "known")


@query("SELECT CAST(count(*) AS BIGINT) n FROM memory", "memory")
def count_all(t):
    return t("memory").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT agent_id FROM mutation_log WHERE op = 'put'", "mutation_log")
def list_agents(t):
    return t("mutation_log").where("op = 'put'").select("agent_id").distinct()


@query(f"SELECT agent_id, id, valid_until FROM memory WHERE valid_until <= {NOW}", "memory")
def scan_expired(t):
    return M.expired(t("memory"), NOW)


@query(f"SELECT agent_id, CAST(count(*) AS BIGINT) examined, CAST(ceil(count(*) / 10.0) AS BIGINT) pages FROM memory WHERE valid_until <= {NOW} GROUP BY agent_id", "memory")
def expired_gc_report(t):
    return M.expired_report(t("memory"), NOW, 10)


@query("SELECT * FROM active", "memory", "active")
def forget_candidates(t):
    return M.forget_candidates(t("memory"), NOW)


@query(f"SELECT agent_id, id, CAST(rank AS INTEGER) rank FROM ranked WHERE rank <= {CAPACITY}", "memory", "active", "ranked")
def retention_survivors(t):
    return M.survivors(t("memory"), CAPACITY, HALF_LIFE, NOW).select("agent_id", "id", "rank")


@query(f"SELECT agent_id, id FROM ranked WHERE rank > {CAPACITY}", "memory", "active", "ranked")
def retention_victims(t):
    return M.victims(t("memory"), CAPACITY, HALF_LIFE, NOW).select("agent_id", "id")


@query(f"SELECT agent_id, CAST(count(*) AS BIGINT) scanned, CAST(greatest(0, count(*) - {CAPACITY}) AS BIGINT) evicted FROM active GROUP BY agent_id", "memory", "active")
def forgetting_report(t):
    return M.forgetting_report(t("memory"), CAPACITY, NOW)


@query("SELECT agent_id, id, arg_max(layer, seq) FILTER (op = 'put') layer, coalesce(arg_max(importance, seq) FILTER (op = 'importance'), arg_max(importance, seq) FILTER (op = 'put')) importance, max(seq) FILTER (op = 'invalidate') valid_until FROM (SELECT *, max(CASE WHEN op IN ('put', 'forget') THEN seq END) OVER (PARTITION BY agent_id, id) m FROM mutation_log) WHERE seq >= m GROUP BY agent_id, id HAVING max(seq) FILTER (op = 'put') IS NOT NULL", "mutation_log")
def memory_fold(t):
    from ..operators.store import fold

    log = t("mutation_log").withColumns({"content": F.lit(""), "valid_from": F.lit(0), "valid_until": F.when(F.col("op") == "invalidate", F.col("seq")), "last_access": F.col("seq"), "vec_id": F.col("seq"), "embedding": F.lit(None).cast("array<float>")})
    return fold(log).select("agent_id", "id", "layer", "importance", "valid_until")


@query(" UNION ALL ".join(f"SELECT {n} AS now, CAST(count(*) AS BIGINT) n FROM memory WHERE valid_from <= {n} AND (valid_until IS NULL OR {n} < valid_until)" for n in (1704067199, 1704067200, 1704070800, 1704070801, NOW)), "memory")
def validity_boundary(t):
    m = t("memory")
    times = [1704067199, 1704067200, 1704070800, 1704070801, NOW]
    one = m.agg(*[F.count_if(valid_at(n)).alias(str(n)) for n in times])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("now"), F.col(f"`{n}`").alias("n")) for n in times])).alias("r")).select("r.*")


@query("SELECT agent_id, source trust, CAST(count(*) AS BIGINT) n FROM memory GROUP BY ALL", "memory")
def trust_breakdown(t):
    return t("memory").groupBy("agent_id", trust().alias("trust")).agg(F.count("*").alias("n"))


def _line(kind: str, *cols: str) -> str:
    """A JSON object without its nulls."""
    pairs = ", ".join(f"'{c}', {c}" for c in cols)
    return f"md5(CAST(json_merge_patch('{{}}', json_object('type', '{kind}', {pairs})) AS VARCHAR)) AS line"


@query(
    f"SELECT 1 part, valid_from n, id k1, '' k2, '' k3, {_line('memory', 'id', 'layer', 'content', 'source', 'valid_from', 'valid_until', 'importance', 'last_access')} FROM memory WHERE agent_id = 'en' "
    f"UNION ALL SELECT 2, 0, id, '', '', {_line('entity', 'id', 'kind', 'label', 'valid_from', 'valid_until')} FROM entity "
    f"UNION ALL SELECT 3, 0, src, dst, relation, {_line('edge', 'src', 'dst', 'relation', 'weight', 'valid_from', 'valid_until')} FROM edge",
    "memory", "entity", "edge",
)
def export_rows(t):
    en = lambda rows: rows.withColumn("agent_id", F.lit("en"))
    return P.export_rows(t("memory"), en(t("entity")), en(t("edge")), "en").withColumn("line", F.md5("line"))


@query("SELECT id, arg_min(source, seq) content, 'import' AS source FROM mutation_log WHERE id NOT IN (SELECT id FROM mutation_log WHERE agent_id = 'user1') GROUP BY id", "mutation_log")
def import_dedup(t):
    log = t("mutation_log")
    rows = log.select("id", F.col("source").alias("content"), "seq", "importance", F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("last_access"))
    return P.import_memories(rows, log, "user1", "seq").select("id", "content", "source")


@query(f"SELECT id, bytes_so_far FROM (SELECT id, valid_from, CAST(sum(strlen(id) + strlen(layer) + 20) OVER (ORDER BY valid_from DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) bytes_so_far FROM (SELECT * FROM memory WHERE agent_id = '{AGENT}' AND {_VALID} ORDER BY valid_from DESC, id LIMIT 100)) WHERE bytes_so_far <= 2000", "memory")
def truncate_to_fit(t):
    rows = M.list_memories(t("memory"), AGENT, 100, NOW).select("id", "layer", "valid_from")
    return M.fit_bytes(rows, [F.desc("valid_from"), F.asc("id")], 2000, ["id", "layer"]).select("id", "bytes_so_far")


@query("SELECT agent_id, id, vec_id FROM memory WHERE embedding IS NULL", "memory")
def verify_missing_vectors(t):
    return M.missing_vectors(t("memory"))


@query("SELECT agent_id, id, CAST(len(embedding) AS INTEGER) dim FROM memory WHERE len(embedding) <> 32", "memory")
def verify_dim_mismatch(t):
    return M.wrong_dimensions(t("memory"), DIM // 2)


def _index(t, memory: DataFrame) -> Index:
    """An index of the memories, in the shared folder."""
    spark = memory.sparkSession
    return Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}").build(memory)


@query(f"SELECT agent_id, vec_id, 'posting_without_memory' kind FROM tok WHERE len(t) > 0 AND NOT ({_VALID}) UNION ALL SELECT DISTINCT agent_id, CAST(NULL AS BIGINT), 'wrong_statistics' FROM tok WHERE len(t) > 0 AND NOT ({_VALID})", "memory", "tok")
def verify_fts_links(t):
    """An index of all memories, held against the valid ones."""
    return _index(t, t("memory")).broken(t("memory").where(valid_at(NOW)))


@query(f"SELECT vec_id, round(score, 6) score FROM bm ORDER BY bm.score DESC, vec_id LIMIT {2 * K}", *_KEY)
def bm25_postings(t):
    return _index(t, t("memory")).top(AGENT, TERMS, 2 * K).select("vec_id", r6("score"))


@query("SELECT 'error' severity, 'wrong_dimension' kind, agent_id, id detail FROM memory WHERE len(embedding) <> 32 UNION ALL SELECT 'error', 'missing_vector', agent_id, id FROM memory WHERE embedding IS NULL UNION ALL SELECT 'error', 'stale_allocator', agent_id, CAST(vec_id AS VARCHAR) FROM memory WHERE vec_id >= 90 UNION ALL SELECT 'warning', 'dangling_edge', agent_id, concat(src, ' ', relation, ' ', dst) FROM edge WHERE NOT EXISTS (SELECT 1 FROM entity n WHERE n.id = src) OR NOT EXISTS (SELECT 1 FROM entity n WHERE n.id = dst)", "memory", "entity", "edge")
def verify_issues(t):
    return R.issues(t("memory"), DIM // 2, 90, entity=t("entity"), edge=t("edge"))


@query(f"SELECT {_LIST} FROM memory WHERE agent_id = '{AGENT}' AND id >= 'm00000050' AND id < 'm00000400'", "memory")
def scan_range(t):
    return M.scan(t("memory"), AGENT, "m00000050", "m00000400").select(*_LIST.split(", "))


@query(f"SELECT {_LIST} FROM memory WHERE agent_id = '{AGENT}' AND id = (SELECT max(id) FROM memory WHERE agent_id = '{AGENT}')", "memory")
def record_get(t):
    last = t("memory").where(F.col("agent_id") == AGENT).agg(F.max("id")).first()[0]
    return M.get(t("memory"), AGENT, last).select(*_LIST.split(", "))


@query(f"SELECT layer FROM memory WHERE agent_id = '{AGENT}' AND id = (SELECT max(id) FROM memory WHERE agent_id = '{AGENT}')", "memory")
def layer_of(t):
    last = t("memory").where(F.col("agent_id") == AGENT).agg(F.max("id")).first()[0]
    return M.layer_of(t("memory"), AGENT, last)


@query("SELECT v.vec_id, agent_id, id FROM (SELECT 3 * vec_id vec_id FROM embeddings) v LEFT JOIN memory m ON m.vec_id = v.vec_id", "memory")
def resolve_vec(t):
    return M.resolve(t("memory"), t("embeddings").select((3 * F.col("vec_id")).alias("vec_id")))


@query(f"SELECT agent_id, id, importance, last_access FROM active WHERE agent_id = '{AGENT}' AND id > 'm00000020' ORDER BY id LIMIT 40", "memory", "active")
def forget_candidates_page(t):
    return M.candidates_page(t("memory"), NOW, AGENT, "m00000020", 40)


@query("SELECT id, kind, label FROM entity WHERE id = 'nation:3'", "entity")
def entity_get(t):
    return G.of(t("entity"), "tpch", id="nation:3").select("id", "kind", "label")


@query("SELECT src, relation, dst, weight, valid_until FROM edge WHERE src = 'nation:3'", "edge")
def out_edges(t):
    return G.of(t("edge"), "tpch", src="nation:3").select("src", "relation", "dst", "weight", "valid_until")


@query("SELECT id, CAST(list_extract(v, 1) AS BIGINT) first, CAST(list_sum(v) AS BIGINT) total, CAST(list_sum(list_transform(v, lambda x, i: x * i)) AS BIGINT) weighted FROM (SELECT id, list(s ORDER BY slot) v FROM (SELECT id, slot, sum(b) s FROM (SELECT id, (i - 1) % 16 slot, CAST(('0x' || substr(h, CAST(2 * i - 1 AS INTEGER), 2)) AS INTEGER) + 1 b FROM (SELECT id, hex(encode(content)) h, unnest(generate_series(1, strlen(content))) i FROM memory) UNION ALL SELECT id, unnest(generate_series(0, 15)), 0 FROM memory UNION ALL SELECT id, 0, 1 FROM memory) GROUP BY ALL) GROUP BY id)", "memory")
def embed_bytes(t):
    v = F.transform("embedding", lambda x: x.cast("long"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = embedded(t("memory").select("id", "content"), ByteEmbedder(16)).select("id", v.alias("v"))
    return rows.select("id", F.get("v", F.lit(0)).alias("first"), add(F.col("v")).alias("total"), add(F.transform("v", lambda x, i: x * (i + 1))).alias("weighted"))


@query(f"SELECT agent_id, vec_id, EXISTS (SELECT 1 FROM memory s WHERE s.agent_id = m.agent_id AND s.layer = 'semantic' AND {_VALID.replace('valid_', 's.valid_')} AND s.content = m.content) OR coalesce((SELECT max(list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))) FROM memory s WHERE s.agent_id = m.agent_id AND s.vec_id <> m.vec_id AND s.layer = 'semantic' AND {_VALID.replace('valid_', 's.valid_')}) >= 0.95, false) known FROM memory m", "memory")
def facts_known(t):
    return M.facts_known(t("memory"), t("memory").select("agent_id", "vec_id", "content", "embedding"), NOW)


@query("SELECT agent_id, src, relation, dst, NOT EXISTS (SELECT 1 FROM entity n WHERE n.id = src) missing_src, NOT EXISTS (SELECT 1 FROM entity n WHERE n.id = dst) missing_dst FROM edge WHERE missing_src OR missing_dst", "entity", "edge")
def dangling_edges(t):
    return G.dangling(t("entity"), t("edge"))


@query("SELECT CAST(coalesce(max(vec_id) + 1, 0) AS BIGINT) next_vec_id FROM memory", "memory")
def allocator_heal(t):
    return M.next_vec_id(t("memory"))


@query(f"SELECT agent_id, id FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM memory m WHERE m.content = e.content AND m.layer = 'semantic' AND {_VALID.replace('valid_', 'm.valid_')})", "episodes", "memory")
def fact_dedup_exact(t):
    facts = t("memory").where(valid_at(NOW) & (F.col("layer") == "semantic")).select("content").distinct()
    return t("episodes").join(facts, "content", "left_anti").select("agent_id", "id")


_KIND = "CASE op WHEN 'put' THEN CASE source WHEN 'consolidation' THEN 'consolidated' ELSE 'remembered' END WHEN 'invalidate' THEN 'invalidated' WHEN 'forget' THEN 'forgotten' END"


@query(f"SELECT agent_id, {_KIND} kind, layer, CAST(count(*) AS BIGINT) n FROM mutation_log WHERE {_KIND} IS NOT NULL GROUP BY ALL", "mutation_log")
def events_by_kind(t):
    return E.events(t("mutation_log")).groupBy("agent_id", "kind", "layer").agg(F.count("*").alias("n"))


@query()
def rate_limit_batch(t):
    calls = t("mutation_log").select("agent_id", "seq", F.unix_timestamp(F.col("event_ts").cast("timestamp")).alias("ts"))
    return E.rate_limit(calls, 5, 86_400)


@query()
def lsh_recall(t):
    """Approximate candidates by random projections, re-ranked exactly, for the probe."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    q = probe(t)
    m = S.by_distance(t("memory").where(F.col("agent_id") == AGENT), q)
    unit = F.transform("embedding", lambda x: x.cast("double"))
    m = m.withColumn("v", array_to_vector(unit))
    from pyspark.ml.linalg import Vectors

    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=8, seed=5).fit(m)
    near = model.approxNearestNeighbors(m, Vectors.dense(q), 4 * K)
    return near.orderBy("distance", "vec_id").limit(K).select("vec_id", r6("distance"))

