"""The change feed: kinds of events, a watch, and the write limit."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import MUTATION, RATE_LIMIT, RATE_WINDOW


def kind() -> Column:
    """remembered or consolidated (by source), invalidated, forgotten; other operations are no events."""
    return F.when(F.col("op") == "put", F.when(F.col("source") == "consolidation", "consolidated").otherwise("remembered")).when(F.col("op") == "invalidate", "invalidated").when(F.col("op") == "forget", "forgotten")


def events(log: DataFrame) -> DataFrame:
    """(seq, agent_id, kind, layer, id), never the content."""
    return log.withColumn("kind", kind()).where("kind is not null").select("seq", "agent_id", "kind", "layer", "id")


def watch(spark: SparkSession, path: str, agent: str, layer: str | None = None) -> DataFrame:
    """A stream of one agent's events from the log of the store at ``path``. Readers that fall behind lose nothing, as long as compact() leaves the old files."""
    feed = events(spark.readStream.schema(MUTATION).option("recursiveFileLookup", "true").parquet(f"{path}/log").where(F.col("agent_id") == agent))
    return feed.where(F.col("layer") == layer) if layer else feed


def relay(feed: DataFrame, deliver: Callable[[dict], object], checkpoint: str, **trigger):
    """Starts a query that hands every event of watch() over, in the log's order within a batch, as a dict of agent_id, kind, layer and id. An event may come
    again after a failure."""

    def batch(rows: DataFrame, _: int) -> None:
        for r in rows.orderBy("seq").select("agent_id", "kind", "layer", "id").toLocalIterator():
            deliver(r.asDict())

    started = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (started.trigger(**trigger) if trigger else started).start()


def _admit(times: list[int], now: int, limit: int, window: int) -> tuple[bool, list[int]]:
    times = [t for t in times if t > now - window]
    return (True, [*times, now]) if len(times) < limit else (False, times)


def rate_limit(calls: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """A batch of calls (agent_id, seq, ts in seconds) with admitted: at most ``limit`` in the ``window`` before; what is refused doesn't count."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, times, out = pdf.sort_values(["ts", "seq"]), [], []
        for t in pdf["ts"]:
            ok, times = _admit(times, t, limit, window)
            out.append(ok)
        return pdf.assign(admitted=out)[["agent_id", "seq", "ts", "admitted"]]

    return calls.select("agent_id", "seq", "ts").groupBy("agent_id").applyInPandas(group, "agent_id string, seq long, ts long, admitted boolean")


def rate_limit_stream(calls: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """The same over a stream; the state of an agent is its admitted times within the window, at most ``limit``."""

    def group(key, batches, state: GroupState):
        times = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf, out = pdf.sort_values(["ts", "seq"]), []
            for t in pdf["ts"]:
                ok, times = _admit(times, t, limit, window)
                out.append(ok)
            yield pdf.assign(admitted=out)[["agent_id", "seq", "ts", "admitted"]]
        state.update((times,))

    return calls.select("agent_id", "seq", "ts").groupBy("agent_id").applyInPandasWithState(group, "agent_id string, seq long, ts long, admitted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)
