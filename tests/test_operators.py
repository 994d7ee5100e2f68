"""Operators on small tables with an explicit time."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import FROM, TO, match_expression, parse_match, query_terms, tokens
from palimpsest.functions.vector import cosine_distance, literal
from palimpsest.operators import consolidation as C
from palimpsest.operators import graph as G
from palimpsest.operators import memories as M
from palimpsest.operators import search as S
from palimpsest.operators.store import Store
from palimpsest.schema import EDGE, ENTITY, MEMORY, check_request, check_text
from palimpsest.sources import porting as P


def mem(spark, *rows):
    base = {"agent_id": "a", "layer": "semantic", "content": "", "source": "user", "valid_from": 0, "valid_until": None, "importance": 1.0, "last_access": 0, "embedding": None}
    return spark.createDataFrame([tuple((base | {"vec_id": i} | r)[f.name] for f in MEMORY) for i, r in enumerate(rows)], MEMORY)


@pytest.mark.parametrize(("now", "n"), [(99, 0), (199, 1), (200, 0)])
def test_validity_boundary(spark, now, n):
    assert M.list_memories(mem(spark, {"id": "x", "valid_from": 100, "valid_until": 200}), "a", 9, now).count() == n


def test_recall_filters_first_and_oversampling_after(spark):
    m = mem(spark, *[{"id": f"b{i}", "agent_id": "b", "embedding": [1.0, 0.0]} for i in range(20)], {"id": "x", "embedding": [0.0, 1.0]}, {"id": "p", "layer": "procedural", "embedding": [1.0, 0.0]}, {"id": "i", "source": "import", "embedding": [1.0, 0.1]})
    assert [r["id"] for r in S.recall(m, "a", [1.0, 0.0], 2, 5).collect()] == ["i", "x"]
    assert S.nearest_oversampled(m, "a", [1.0, 0.0], 1, 5).count() == 0
    assert [r["id"] for r in S.recall(m, "a", [1.0, 0.0], 2, 5, exclude_imported=True).collect()] == ["x"]
    assert [r["id"] for r in S.recall(m, "a", [1.0, 0.0], 2, 5, layer="procedural").collect()] == ["p"]


def test_zero_vector_is_at_distance_one(spark):
    assert spark.range(1).select(cosine_distance(literal([0.0, 0.0]), literal([1.0, 0.0]))).first()[0] == 1.0


def test_fusion_numbers_and_ties(spark):
    one = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "rank int, id string")
    out = {r["id"]: (round(r["score"], 9), list(r["contributions"])) for r in S.fuse({"v": one("a", "b"), "k": one("a", "c")}).collect()}
    assert out == {"a": (round(2 / 60, 9), ["v", "k"]), "b": (round(1 / 61, 9), ["v"]), "c": (round(1 / 61, 9), ["k"])}


def test_bm25_order_and_repeated_terms(spark):
    m = mem(spark, {"id": "x", "content": "cat dog cat bird"}, {"id": "y", "content": "cat dog fish bird"}, {"id": "z", "content": "..."})
    once = {r["vec_id"]: r["score"] for r in S.bm25(m, "a", ["cat"]).collect()}
    assert once[0] > once[1] and set(once) == {0, 1}
    twice = {r["vec_id"]: r["score"] for r in S.bm25(m, "a", ["cat", "cat"]).collect()}
    assert abs(twice[0] - 2 * once[0]) < 1e-12
    assert [r["vec_id"] for r in S.bm25_top(m, "a", ["fish", "cat"], 1).collect()] == [1]


def test_tokens_fold(spark):
    assert len(FROM) == len(TO)
    assert spark.createDataFrame([("Été, ŒUVRE straße—x2",)], "t string").select(tokens("t")).first()[0] == ["ete", "ouvre", "strase", "x2"]
    assert query_terms("Été ok") == ["ete", "ok"] and match_expression("!!") is None and parse_match('"a" OR "b"') == ["a", "b"]
    with pytest.raises(ValueError):
        parse_match("a AND b")


def test_traversal(spark):
    node = lambda i, end=None: ("a", i, "k", i, 0, end)
    ent = spark.createDataFrame([node("s"), node("l"), node("r"), node("end"), node("gone", 5)], ENTITY)
    edge = lambda s, d, end=None: ("a", s, "rel", d, 1.0, 99, end)
    edges = spark.createDataFrame([edge("s", "l"), edge("s", "r"), edge("l", "end"), edge("r", "end"), edge("end", "s"), edge("s", "gone"), edge("gone", "ghost"), edge("s", "cut", 3)], EDGE)
    got = sorted((r["depth"], r["id"]) for r in G.traverse(ent, edges, "a", "s", 5, 10).collect())
    assert got == [(1, "l"), (1, "r"), (2, "end")]
    assert G.traverse(ent, edges, "b", "s", 5, 10).count() == 0
    assert {r["dst"] for r in G.dangling(ent, edges).collect()} == {"ghost", "cut"}


def test_retention_and_expiry_are_disjoint(spark):
    m = mem(spark, *[{"id": f"m{i + 1}", "importance": x} for i, x in enumerate([0.1, 0.9, 0.5, 0.7, 0.3])], {"id": "old", "valid_until": 5})
    assert sorted(r["id"] for r in M.victims(m, 3, 10.0, 9).collect()) == ["m1", "m5"]
    assert [r["id"] for r in M.expired(m, 9).collect()] == ["old"]
    assert M.victims(m, 0, 10.0, 9).count() == 5
    with pytest.raises(ValueError):
        M.expired_report(m, 9, 0)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    a, b = s.agent("a"), s.agent("b")
    a.remember([{"id": "x", "content": "one", "embedding": [1.0, 0.0]}, {"id": "y", "content": "two"}], 10)
    b.remember([{"id": "x", "content": "other"}], 10)
    with pytest.raises(ValueError):
        a.remember([{"id": "x", "content": "again"}], 11)
    assert a.invalidate(["x", "none"], 20) == 1 and a.set_importance("y", 0.5, 21) == 1
    assert b.forget(["y"], 22) == 0 and s.agents() == ["a", "b"]
    state = lambda: {r["id"]: (r["valid_until"], r["importance"]) for r in a.memory().collect()}
    assert state() == {"x": (20, 1.0), "y": (None, 0.5)}
    s.compact()
    assert state() == {"x": (20, 1.0), "y": (None, 0.5)} and a.collect_expired(30) == 1
    assert set(state()) == {"y"} and [r["content"] for r in b.memory().collect()] == ["other"]
    s.purge("a")
    assert a.memory().count() == 0 and s.agents() == ["b"]


def test_export_and_import(spark, tmp_path):
    m = mem(spark, {"id": "x", "content": "one"}, {"id": "y", "content": "two", "valid_until": 3})
    none = spark.createDataFrame([], ENTITY), spark.createDataFrame([], EDGE)
    P.export_jsonl(m, *none, "a", str(tmp_path / "e"), 9)
    rows = P.read_jsonl(spark, str(tmp_path / "e"))
    new = P.import_memories(rows.where("type = 'memory'"), mem(spark, {"id": "x"}), "a")
    assert [(r["id"], r["source"]) for r in new.collect()] == [("y", "import")]
    (tmp_path / "bad").write_text('{"type": "memory"}\n')
    with pytest.raises(ValueError):
        P.read_jsonl(spark, str(tmp_path / "bad"))


def test_consolidation():
    assert C.build_prompt([]) is None and "one" in C.build_prompt(["one"])
    assert C.parse('```json\n{"facts": ["a"]}\n```') == {"facts": ["a"], "entities": [], "relations": []}
    assert C.accept([("a", [1.0, 0.0]), ("a", None), ("b", [1.0, 0.01]), ("c", [0.0, 1.0]), ("k", None)], {"k"}, lambda v: 0.0) == [0, 3]


def test_bounds():
    with pytest.raises(ValueError):
        check_text("é" * 40_000)
    with pytest.raises(ValueError):
        check_request(k=101)


def test_rate_limit(spark):
    from palimpsest.streaming.events import rate_limit

    calls = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 1, 2, 60, 61])], "agent_id string, seq long, ts long")
    assert [r["admitted"] for r in rate_limit(calls, 2, 60).orderBy("seq").collect()] == [True, True, False, True, True]


def test_queries_agree_with_sql(spark):
    """Some registered queries on the smallest data against DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    from palimpsest.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("recall_hybrid", "bm25_topk", "graph_traverse_d3", "retention_victims", "memory_fold", "agent_stats"):
        df = catalog.QUERIES[name](spark, d)
        cur = con.execute(catalog.SQL[name])
        order = [x[0] for x in cur.description]
        ours = sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in order) for r in df.select(*[F.col(c) for c in order]).collect())
        assert ours == sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in cur.fetchall()), name


def test_tokens_agree_with_query_terms(spark):
    from palimpsest.functions.text import query_terms, tokens

    texts = ["İstanbul şehri", "नमस्ते दुनिया", "snake_case x-1", "Œuvre Ærø ß", "日本 語", "", "ÀÉ"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens("t").alias("w")).orderBy("i").collect()
    assert [r["w"] for r in got] == [query_terms(t) for t in texts]


def test_batch_nearest_of_mixed_lengths(spark):
    from palimpsest.operators.search import batch_nearest

    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 3, [1.0, 0.0, 0.0]), ("a", 4, [0.9, 0.1]), ("a", 5, [1.0])]
    m = spark.createDataFrame([(*r, "semantic", 0, None) for r in rows], "agent_id string, vec_id long, embedding array<float>, layer string, valid_from long, valid_until long")
    got = {(r["query_id"], r["vec_id"]) for r in batch_nearest(m, m.where("vec_id in (1, 3, 5)"), 5, 10).collect()}
    assert got == {(1, 2), (1, 4)}


def test_watch_on_a_store(spark, tmp_path):
    from palimpsest.operators.store import Store
    from palimpsest.streaming.events import watch

    s = Store(spark, str(tmp_path / "s"))
    put = {"op": "put", "agent_id": "a", "id": "m1", "layer": "semantic", "content": "x", "source": "user", "valid_from": 1, "vec_id": 0, "ts": 1}
    s.append([put, put | {"agent_id": "b", "id": "m2", "vec_id": 1}])
    q = watch(spark, str(tmp_path / "s"), "a").writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["kind"], r["id"]) for r in spark.table("watched").collect()] == [("remembered", "m1")]


def test_spaced_counts(spark):
    from palimpsest.functions.text import spaced, term_count, token_count

    rows = spark.createDataFrame([("a a. A aa", 1), ("...", 2), ("", 3), (None, 4), ("x", 5)], "t string, i int").select("i", spaced("t").alias("r")).select("i", token_count(F.col("r")).alias("n"), term_count(F.col("r"), "a").alias("a"))
    assert [(r["n"], r["a"]) for r in rows.orderBy("i").collect()] == [(4, 3), (0, 0), (0, 0), (0, 0), (1, 0)]


def test_byte_embedder(spark):
    from palimpsest.functions.embed import ByteEmbedder, embedded

    rows = spark.createDataFrame([("ab", 1), ("", 2), (None, 3), ("abc", 4)], "content string, i int")
    assert [r["embedding"] for r in embedded(rows, ByteEmbedder(2)).orderBy("i").collect()] == [[99.0, 99.0], [1.0, 0.0], None, [199.0, 99.0]]


def test_index_scores_as_the_scan(spark, tmp_path):
    from palimpsest.operators.postings import Index
    from palimpsest.operators.repair import issues, plan, rebuild

    m = mem(spark, {"id": "x", "content": "cat dog cat bird"}, {"id": "y", "content": "cat dog fish bird"}, {"id": "z", "content": "..."}, {"id": "o", "agent_id": "b", "content": "cat"})
    index = Index(spark, str(tmp_path / "i")).build(m)
    for terms in (["cat"], ["cat", "fish", "cat"], ["none"]):
        both = [sorted((r["vec_id"], round(r["score"], 9)) for r in t.collect()) for t in (S.bm25(m, "a", terms), index.bm25("a", terms))]
        assert both[0] == both[1]
    assert index.bm25("a", []).count() == 0 and index.broken(m).count() == 0
    other = mem(spark, {"id": "x", "content": "cat"}, {"id": "n", "content": "new", "vec_id": 9, "embedding": [1.0]})
    found = {(r["kind"], r["detail"]) for r in issues(other, 2, 5, index).collect()}
    assert found == {("missing_vector", "x"), ("wrong_dimension", "n"), ("stale_allocator", "9"), ("wrong_counts", "0"), ("posting_without_memory", "1"), ("posting_without_memory", "3"), ("memory_without_postings", "9"), ("wrong_statistics", None)}
    assert plan(k for k, _ in sorted(found, key=str))["at_risk"] == [] and plan(["repeated_id", "dangling_edge"]) == {"actions": [], "warnings": ["dangling_edge"], "at_risk": ["repeated_id"]}
    assert rebuild(other, index)[1].count() == 1 and index.broken(other).count() == 0


def test_deep_traversal_has_a_flat_plan(spark):
    ent = spark.createDataFrame([("a", str(i), "k", str(i), 0, None) for i in range(13)], ENTITY)
    edges = spark.createDataFrame([("a", str(i), "r", str(i + 1), 1.0, 0, None) for i in range(12)], EDGE)
    out = G.traverse(ent, edges, "a", "0", 10, 5)
    assert out.count() == 10 and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_store_with_text_graph_and_consolidation(spark, tmp_path):
    from palimpsest.functions.embed import ByteEmbedder

    s = Store(spark, str(tmp_path / "s"), ByteEmbedder(8))
    a, b = s.agent("a"), s.agent("b")
    a.remember([{"id": "x", "content": "likes tea", "layer": "semantic"}, {"id": "e", "content": "said hello"}], 10)
    assert a.recall("likes tea", 1, 20).first()["id"] == "x" and a.recall_hybrid("tea", 1, 20).count() == 1
    assert [r["vec_id"] for r in a.keywords("tea", 5).collect()] == [0] and b.keywords("tea", 5).count() == 0
    assert a.layer_of("x") == "semantic" and a.layer_of("none") is None and b.get("x").count() == 0
    assert [(r["vec_id"], r["id"]) for r in s.resolve([0, 77]).orderBy("vec_id").collect()] == [(0, "x"), (77, None)]
    assert s.meta_ensure("model", "m1") == "m1" and s.meta_ensure("model", "m2") == "m1" and s.metadata() == {"model": "m1"}

    answer = '```json\n{"facts": ["likes tea", "Zzz", "Zzz", "plays 9999 on sundays"], "entities": [{"id": "t", "kind": "drink", "label": "tea"}], "relations": [{"src": "u", "relation": "likes", "dst": "t"}]}\n```'
    report = a.consolidate(lambda prompt: answer, 30)
    assert report["episodes"] == 1 and report["entities"] == report["relations"] == 1 and report["facts_added"] + report["facts_skipped"] == 4
    assert report["facts_skipped"] >= 2 and s.agent("b").consolidate(lambda p: answer, 30)["facts_added"] == 0
    again = a.consolidate(lambda prompt: answer, 31)
    assert again["facts_added"] == 0
    assert [r["id"] for r in a.traverse("u", 3, 40).collect()] == ["t"] and b.edges().count() == 0
    a.add_edge("u", "likes", "t", 0.5, 99)
    a.add_entity("t", "drink", "black tea", 50)
    state = lambda: ([(r["weight"], r["valid_from"]) for r in a.edges(src="u").collect()], [r["label"] for r in a.entities(id="t").collect()])
    assert state() == ([(0.5, 30)], ["black tea"])
    s.compact()
    assert state() == ([(0.5, 30)], ["black tea"]) and s.gauges()["log_parts"] == 1

    s.embedder = ByteEmbedder(4)
    n, missing = a.reembed(60, ["x", "none"])
    assert n == 1 and [r["id"] for r in missing.collect()] == ["none"] and len(a.get("x").first()["embedding"]) == 4
    assert s.reembed_missing(61) == 0 and a.forget(["none"], 62) == 0 and a.forget_to(0, 10.0, 63) == s.log().where("op = 'forget'").count()
    s.purge("a")
    assert a.memory().count() == 0 and a.edges().count() == 0 and s.count() == 0
    for bad in ('{"facts": [1]}', '{"entities": [{"id": "x"}]}', "[]"):
        with pytest.raises(ValueError):
            C.parse(bad)


def test_worker_and_relay(spark, tmp_path):
    import threading

    from palimpsest.streaming.events import relay, watch
    from palimpsest.streaming.tasks import Worker, collection

    s = Store(spark, str(tmp_path / "s"))
    a = s.agent("a")
    a.remember([{"id": "x", "content": "one", "valid_until": 5}, {"id": "y", "content": "two", "source": "consolidation"}], 1)
    done, calls = threading.Event(), []

    def fails_first():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("once")
        collection(a, lambda: 9)()
        done.set()

    w = Worker().register("gc", 0.05, fails_first).start()
    assert done.wait(60)
    w.stop()
    assert [r["id"] for r in a.memory().collect()] == ["y"]
    got = []
    relay(watch(spark, str(tmp_path / "s"), "a"), got.append, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert [(e["kind"], e["id"]) for e in got] == [("remembered", "x"), ("consolidated", "y"), ("forgotten", "x")]
