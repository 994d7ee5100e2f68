"""Tables, constants and checks of the data model."""

from __future__ import annotations

import math

from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


MEMORY = _table(("agent_id", _s, False), ("id", _s, False), ("layer", _s, False), ("content", _s, False), ("source", _s, False), ("valid_from", _l, False), ("valid_until", _l, True), ("importance", _d, False), ("last_access", _l, False), ("vec_id", _l, False), ("embedding", T.ArrayType(T.FloatType()), True))
ENTITY = _table(("agent_id", _s, False), ("id", _s, False), ("kind", _s, False), ("label", _s, False), ("valid_from", _l, False), ("valid_until", _l, True))
EDGE = _table(("agent_id", _s, False), ("src", _s, False), ("relation", _s, False), ("dst", _s, False), ("weight", _d, False), ("valid_from", _l, False), ("valid_until", _l, True))
MUTATION = _table(("seq", _l, False), ("ts", _l, False), ("op", _s, False), *((f.name, f.dataType, f.name not in ("agent_id", "id")) for f in MEMORY))
#: The store's graph log: upserts of entities and edges.
GRAPH = _table(("seq", _l, False), ("op", _s, False), ("agent_id", _s, False), *((n, t, True) for n, t in (("id", _s), ("kind", _s), ("label", _s), ("src", _s), ("relation", _s), ("dst", _s), ("weight", _d), ("valid_from", _l), ("valid_until", _l))))

LAYERS = ("short_term", "episodic", "procedural", "semantic")
SOURCES = ("user", "consolidation", "import")
MAX_TEXT_BYTES = 65_535
OVERSAMPLE, SIGNAL_DEPTH = 8, 4
RRF_K, BM25_K1, BM25_B = 60.0, 1.2, 0.75
QUERY_TOKENS = 32
FACT_COSINE = 0.95
EPISODES, FACTS, ENTITIES, RELATIONS = 50, 100, 200, 500
RATE_LIMIT, RATE_WINDOW = 60, 60
PAGE = 1000


def check_text(text: str) -> str:
    if len(text.encode()) > MAX_TEXT_BYTES:
        raise ValueError(f"text is longer than {MAX_TEXT_BYTES} bytes")
    return text


def check_importance(x: float) -> float:
    if not math.isfinite(x):
        raise ValueError("importance must be finite")
    return x


def check_layer(layer: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    return layer


def check_request(agent: str = "a", query: str = "q", k: int = 1, depth: int = 1) -> None:
    """Bounds of the service surfaces."""
    for name, ok in (("agent", 1 <= len(agent) <= 128), ("query", 1 <= len(query) <= 4096), ("k", 1 <= k <= 100), ("depth", 1 <= depth <= 10)):
        if not ok:
            raise ValueError(f"{name} is out of bounds")
