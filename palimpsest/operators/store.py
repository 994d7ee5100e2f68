"""A store of one writer: an append-only log of mutations, snapshots made by folding it, and a manifest that names the current one.

Mutations of memories and upserts of the graph have a log each; rows of one batch that was made by a plan share a number.
put fails on an id that exists; invalidate sets the end, forget deletes, touch raises last_access, importance replaces. The files are Parquet; the
manifest is replaced by a rename, so readers see one generation or the next. Forgotten rows leave the disk when compact() has run and
old generations are deleted.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedder, embedded
from ..functions.text import query_terms
from ..schema import EDGE, ENTITY, EPISODES, GRAPH, MEMORY, MUTATION, check_importance, check_layer, check_text
from . import consolidation, graph, memories, search
from .postings import Index

FIELDS = [f.name for f in MEMORY if f.name not in ("agent_id", "id")]


def fold(log: DataFrame) -> DataFrame:
    """The memories that a log leaves. Operations before a row's (last) put, or behind its forget, have no effect."""
    key = ["agent_id", "id"]
    w = Window.partitionBy(*key)
    last = F.max(F.when(F.col("op").isin("put", "forget"), F.col("seq"))).over(w)
    live = log.withColumn("_last", last).where("seq >= _last")
    latest = lambda op, col: F.max_by(F.when(F.col("op") == op, F.col(col)), F.when(F.col("op") == op, F.col("seq")))
    out = live.groupBy(*key).agg(
        F.max_by(F.struct("op", *FIELDS), F.when(F.col("op").isin("put", "forget"), F.col("seq"))).alias("r"),
        latest("invalidate", "valid_until").alias("end"), latest("importance", "importance").alias("imp"), F.max(F.when(F.col("op") == "touch", F.col("last_access"))).alias("touched"), latest("embed", "embedding").alias("vec"),
    ).where("r.op = 'put'")
    row = {f: F.col(f"r.{f}") for f in FIELDS}
    row |= {"valid_until": F.coalesce("end", "r.valid_until"), "importance": F.coalesce("imp", "r.importance"), "last_access": F.greatest("r.last_access", F.coalesce("touched", "r.last_access")), "embedding": F.coalesce("vec", "r.embedding")}
    return out.select(*key, *[row[f].alias(f) for f in FIELDS])


class Store:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.embedder = spark, Path(path), embedder
        (self.path / "log").mkdir(parents=True, exist_ok=True)  # apart from manifest and snapshots, so that it can be watched
        if not (self.path / "CURRENT").exists():
            self._commit({"snapshot": None, "log": [], "graph": [], "meta": {}, "seq": 0, "vec": 0, "agents": []})

    def _manifest(self) -> dict:
        return {"graph": [], "meta": {}} | json.loads((self.path / "CURRENT").read_text())

    def _commit(self, manifest: dict) -> None:
        new = self.path / f"CURRENT.{uuid.uuid4().hex}"
        new.write_text(json.dumps(manifest))
        os.replace(new, self.path / "CURRENT")

    def _read(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[str(self.path / n) for n in names]) if names else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        m = self._manifest()
        return self._read([*([m["snapshot"]] if m["snapshot"] else []), *m["log"]], MUTATION)

    def graph_log(self) -> DataFrame:
        return self._read(self._manifest()["graph"], GRAPH)

    def entity(self) -> DataFrame:
        return graph.fold_entities(self.graph_log().where("op = 'entity'").select("seq", *[f.name for f in ENTITY])).select(*[f.name for f in ENTITY])

    def edge(self) -> DataFrame:
        return graph.fold_edges(self.graph_log().where("op = 'edge'").select("seq", *[f.name for f in EDGE])).select(*[f.name for f in EDGE])

    def resolve(self, vec_ids: list[int]) -> DataFrame:
        """(vec_id, agent_id, id)."""
        return memories.resolve(self.memory(), self.spark.createDataFrame([(v,) for v in vec_ids], "vec_id long"))

    def count(self) -> int:
        return self.memory().count()

    def metadata(self) -> dict[str, str]:
        return dict(sorted(self._manifest()["meta"].items()))

    def meta_ensure(self, name: str, value: str) -> str:
        """Sets a name that isn't set yet; what is stored then."""
        m = self._manifest()
        if name not in m["meta"]:
            m["meta"][name] = value
            self._commit(m)
        return m["meta"][name]

    def gauges(self) -> dict[str, int]:
        """Files and bytes that the current generation takes, log parts since the last compaction, the last number."""
        m = self._manifest()
        files = [f for n in [m["snapshot"], *m["log"], *m["graph"]] if n for f in (self.path / n).rglob("*.parquet")]
        return {"files": len(files), "bytes": sum(f.stat().st_size for f in files), "log_parts": len(m["log"]) + len(m["graph"]), "seq": m["seq"]}

    def index(self) -> Index:
        """The inverted index of the current state: kept under the number of its last mutation, made where there is none yet; older ones go."""
        at = self.path / "index" / f"{self._manifest()['seq']:012d}"
        found = Index(self.spark, str(at))
        if not (at / "stats" / "_SUCCESS").exists():
            found.build(self.memory())
            for old in (self.path / "index").iterdir():
                if old != at:
                    shutil.rmtree(old, ignore_errors=True)
        return found

    def append_graph(self, rows: list[dict]) -> None:
        if not rows:
            return
        m = self._manifest()
        rows = [r | {"seq": m["seq"] + 1 + i} for i, r in enumerate(rows)]
        m["seq"] += len(rows)
        name = f"graph/{m['seq']:012d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([tuple(r.get(f.name) for f in GRAPH) for r in rows], GRAPH).coalesce(1).write.parquet(str(self.path / name))
        m["graph"].append(name)
        self._commit(m)

    def append_plan(self, rows: DataFrame, op: str, now: int) -> int:
        """Appends an operation for each row (agent_id, id and the operation's field) of a plan, at most one for an id; how many there were. Nothing passes through the driver."""
        m = self._manifest()
        m["seq"] += 1
        fields = {f.name: F.lit(None).cast(f.dataType) for f in MUTATION} | {"seq": F.lit(m["seq"]).cast("long"), "ts": F.lit(now).cast("long"), "op": F.lit(op)} | {c: F.col(c) for c in rows.columns}
        name = f"log/{m['seq']:012d}-{uuid.uuid4().hex}"
        rows.select(*[fields[f.name].cast(f.dataType).alias(f.name) for f in MUTATION]).write.parquet(str(self.path / name))
        n = self._read([name], MUTATION).count()
        if n:
            m["log"].append(name)
            self._commit(m)
        else:
            shutil.rmtree(self.path / name, ignore_errors=True)
        return n

    def reembed_missing(self, now: int) -> int:
        """Vectors for all memories, of every agent, that have none; vec_ids stay."""
        return self._reembed(self.memory().where("embedding is null"), now)

    def _reembed(self, rows: DataFrame, now: int) -> int:
        if self.embedder is None:
            raise ValueError("the store has no embedder")
        return self.append_plan(embedded(rows.select("agent_id", "id", "content"), self.embedder).drop("content"), "embed", now)

    def memory(self) -> DataFrame:
        return fold(self.log())

    def agent(self, agent: str) -> Agent:
        return Agent(self, agent)

    def agents(self) -> list[str]:
        """Agents that ever remembered something and weren't purged."""
        return sorted(self._manifest()["agents"])

    def append(self, rows: list[dict]) -> None:
        if not rows:
            return
        m = self._manifest()
        for r in rows:
            m["seq"] += 1
            r["seq"] = m["seq"]
        blank = dict.fromkeys(f.name for f in MUTATION)
        name = f"log/{m['seq']:012d}-{uuid.uuid4().hex}"
        table = self.spark.createDataFrame([tuple((blank | r)[f.name] for f in MUTATION) for r in rows], MUTATION)
        table.coalesce(1).write.parquet(str(self.path / name))
        m["log"].append(name)
        m["vec"] = max([m["vec"], *(r["vec_id"] + 1 for r in rows if r["op"] == "put")])
        m["agents"] = sorted({*m["agents"], *(r["agent_id"] for r in rows if r["op"] == "put")})
        self._commit(m)

    def compact(self, drop_old: bool = False) -> None:
        """Folds the logs into new snapshots. With drop_old the files before them go, under readers that may still be at them."""
        m = self._manifest()
        state = self.memory().withColumns({"seq": F.lit(m["seq"]).cast("long"), "ts": F.col("valid_from"), "op": F.lit("put")}).select(*[f.name for f in MUTATION])
        self._replace(m, state, self._graph_state(m["seq"]), drop_old)

    def _graph_state(self, seq: int) -> DataFrame:
        shaped = lambda t, op: t.select(*[(F.lit(seq) if f.name == "seq" else F.lit(op) if f.name == "op" else F.col(f.name) if f.name in t.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in GRAPH])
        return shaped(self.entity(), "entity").unionByName(shaped(self.edge(), "edge"))

    def purge(self, agent: str) -> None:
        """All of an agent, its graph too, without events; no file that holds its rows is left."""
        m = self._manifest()
        m["agents"] = [a for a in m["agents"] if a != agent]
        self._replace(m, self.log().where(F.col("agent_id") != agent), self.graph_log().where(F.col("agent_id") != agent), True)
        shutil.rmtree(self.path / "index", ignore_errors=True)

    def _replace(self, m: dict, log: DataFrame, graph_log: DataFrame, drop_old: bool) -> None:
        tag = f"{m['seq']:012d}-{uuid.uuid4().hex}"
        # by id as well as agent: a large agent goes to several files
        log.repartitionByRange("agent_id", "id").sortWithinPartitions("agent_id", "id").write.parquet(str(self.path / f"gen-{tag}"))
        graph_log.repartitionByRange("agent_id", "op", "id", "src", "dst").sortWithinPartitions("agent_id", "op", "id", "src", "dst").write.parquet(str(self.path / f"graph/gen-{tag}"))
        old = [m["snapshot"], *m["log"], *m["graph"]]
        self._commit(m | {"snapshot": f"gen-{tag}", "log": [], "graph": [f"graph/gen-{tag}"]})
        for n in old if drop_old else []:
            if n:
                shutil.rmtree(self.path / n, ignore_errors=True)


class Agent:
    """What one agent may read and write: every read is of its rows alone."""

    def __init__(self, store: Store, agent: str):
        self.store, self.agent = store, agent

    def memory(self) -> DataFrame:
        return search.of_agent(self.store.memory(), self.agent)

    def remember(self, items: list[dict], now: int) -> list[str]:
        """items: content and, if wanted, id, layer, source, valid_from, valid_until, importance, embedding (else the store's embedder makes it, all at once). All or none are put."""
        for x in items:
            check_text(x["content"])
        bare = [i for i, x in enumerate(items) if x.get("embedding") is None] if self.store.embedder else []
        made = dict(zip(bare, self.store.embedder([items[i]["content"] for i in bare]), strict=True)) if bare else {}
        vec, rows = self.store._manifest()["vec"], []
        for i, x in enumerate(items):
            start = x.get("valid_from", now)
            rows.append({"agent_id": self.agent, "id": x.get("id") or str(uuid.uuid4()), "ts": now, "op": "put", "layer": check_layer(x.get("layer", "episodic")), "content": check_text(x["content"]), "source": x.get("source", "user"), "valid_from": start, "valid_until": x.get("valid_until"), "importance": check_importance(float(x.get("importance", 1.0))), "last_access": start, "vec_id": vec + i, "embedding": made.get(i, x.get("embedding"))})
        ids = [r["id"] for r in rows]
        if len(set(ids)) < len(ids) or ids and not self._these(ids).isEmpty():
            raise ValueError("an id exists already")
        self.store.append(rows)
        return ids

    def _these(self, ids: list[str]) -> DataFrame:
        """The memories of some ids."""
        return self.memory().join(self.store.spark.createDataFrame([(i,) for i in set(ids)], "id string"), "id", "left_semi")

    def _if_there(self, ids: list[str], op: str, now: int, **fields) -> int:
        if not ids:
            return 0
        return self.store.append_plan(self._these(ids).select("agent_id", "id", *[F.lit(v).alias(k) for k, v in fields.items()]), op, now)

    def invalidate(self, ids: list[str], now: int) -> int:
        return self._if_there(ids, "invalidate", now, valid_until=now)

    def forget(self, ids: list[str], now: int) -> int:
        return self._if_there(ids, "forget", now)

    def touch(self, ids: list[str], now: int) -> int:
        return self._if_there(ids, "touch", now, last_access=now)

    def set_importance(self, ident: str, importance: float, now: int) -> int:
        return self._if_there([ident], "importance", now, importance=check_importance(importance))

    def recall_and_touch(self, query: list[float], k: int, now: int, **more) -> list:
        rows = search.recall(self.store.memory(), self.agent, query, k, now, **more).collect()
        self.touch([r["id"] for r in rows], now)
        return rows

    def forget_to(self, capacity: int, half_life: float, now: int) -> int:
        """Adaptive forgetting: the victims go from the plan to the log."""
        return self.store.append_plan(memories.victims(self.memory(), capacity, half_life, now).select("agent_id", "id"), "forget", now)

    def collect_expired(self, now: int) -> int:
        return self.store.append_plan(memories.expired(self.memory(), now).select("agent_id", "id"), "forget", now)

    def get(self, ident: str) -> DataFrame:
        return memories.get(self.memory(), self.agent, ident)

    def layer_of(self, ident: str) -> str | None:
        found = memories.layer_of(self.memory(), self.agent, ident).first()
        return found and found["layer"]

    def _vector(self, text: str) -> list[float]:
        if self.store.embedder is None:
            raise ValueError("the store has no embedder")
        return self.store.embedder([text])[0]

    def recall(self, text: str, k: int, now: int, **more) -> DataFrame:
        return search.recall(self.store.memory(), self.agent, self._vector(text), k, now, **more)

    def recall_hybrid(self, text: str, k: int, now: int, **more) -> DataFrame:
        return search.recall_hybrid(self.store.memory(), self.agent, self._vector(text), query_terms(text), k, now, **more)

    def keywords(self, text: str, k: int) -> DataFrame:
        """(vec_id, score) from the stored index."""
        return self.store.index().top(self.agent, query_terms(text), k)

    def reembed(self, now: int, ids: list[str] | None = None) -> tuple[int, DataFrame | None]:
        """New vectors for some ids or all of the agent; how many, and the ids that aren't there."""
        if ids is None:
            return self.store._reembed(self.memory(), now), None
        asked = self.store.spark.createDataFrame([(i,) for i in set(ids)], "id string")
        missing = asked.join(self.memory().select("id"), "id", "left_anti")
        return self.store._reembed(self._these(ids), now), missing

    def add_entity(self, ident: str, kind: str, label: str, valid_from: int, valid_until: int | None = None) -> None:
        """Replaces an entity of that id in all fields."""
        self.store.append_graph([self._entity(ident, kind, label, valid_from, valid_until)])

    def add_edge(self, src: str, relation: str, dst: str, weight: float, now: int) -> None:
        """Of an edge that exists only the weight changes."""
        self.store.append_graph([self._edge(src, relation, dst, weight, now)])

    def _entity(self, ident: str, kind: str, label: str, start: int, end: int | None = None) -> dict:
        return {"op": "entity", "agent_id": self.agent, "id": check_text(ident), "kind": check_text(kind), "label": check_text(label), "valid_from": start, "valid_until": end}

    def _edge(self, src: str, relation: str, dst: str, weight: float, now: int) -> dict:
        return {"op": "edge", "agent_id": self.agent, "src": check_text(src), "relation": check_text(relation), "dst": check_text(dst), "weight": check_importance(float(weight)), "valid_from": now}

    def entities(self, **key: str) -> DataFrame:
        return graph.of(self.store.entity(), self.agent, **key)

    def edges(self, **key: str) -> DataFrame:
        return graph.of(self.store.edge(), self.agent, **key)

    def traverse(self, start: str, depth: int, now: int) -> DataFrame:
        return graph.traverse(self.store.entity(), self.store.edge(), self.agent, start, depth, now)

    def episodes(self, now: int) -> list[str]:
        return [r["content"] for r in memories.recent_episodes(self.memory(), self.agent, EPISODES, now).collect()]

    def apply(self, extraction: dict, now: int) -> dict[str, int]:
        """Upserts entities and edges (weight 1), then puts the facts that are new as semantic memories of source consolidation. One after the other: a fact
        also meets those accepted before it."""
        facts = consolidation.check(extraction)["facts"]
        self.store.append_graph([*(self._entity(e["id"], e["kind"], e["label"], now) for e in extraction["entities"]), *(self._edge(r["src"], r["relation"], r["dst"], 1.0, now) for r in extraction["relations"])])
        vectors = self.store.embedder(facts) if self.store.embedder and facts else [None] * len(facts)
        known = set()
        if facts:
            # below every vec_id, so that no memory counts as the fact itself
            asked = self.store.spark.createDataFrame([(self.agent, -1 - i, f, v) for i, (f, v) in enumerate(zip(facts, vectors, strict=True))], "agent_id string, vec_id long, content string, embedding array<float>")
            known = {-1 - r["vec_id"] for r in memories.facts_known(self.memory(), asked, now).where("known").collect()}  # at most FACTS rows
        rest = [i for i in range(len(facts)) if i not in known]
        taken = [rest[j] for j in consolidation.accept([(facts[i], vectors[i]) for i in rest], set(), lambda v: -1.0)]
        self.remember([{"content": facts[i], "layer": "semantic", "source": "consolidation", "embedding": vectors[i]} for i in taken], now)
        return {"entities": len(extraction["entities"]), "relations": len(extraction["relations"]), "facts_added": len(taken), "facts_skipped": len(facts) - len(taken), "episodes": 0}

    def consolidate(self, complete, now: int) -> dict[str, int]:
        """complete: a language model, from a prompt to an answer. Nothing is written without episodes."""
        episodes = self.episodes(now)
        if not episodes:
            return {"entities": 0, "relations": 0, "facts_added": 0, "facts_skipped": 0, "episodes": 0}
        return self.apply(consolidation.parse(complete(consolidation.build_prompt(episodes))), now) | {"episodes": len(episodes)}
