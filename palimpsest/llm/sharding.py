"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id). Splitters between shards are found by counting: in each round the
bytes below the boundaries of 1,024 equal parts of each splitter's open interval are summed over all partitions, and the interval shrinks to
the part in which the target lies, until a boundary meets the tolerance. Rows of equal texts have one first key, so they share
a shard unless their own bytes exceed the tolerance at a splitter; only then are they split, by the second key. Rows are exchanged once, to
bins of a shard, where they get slots; a bin's first slot follows from counts. Rows of one text and id that a splitter divides (repeated rows) are numbered.

Laws: ``bytes`` (sizes within the tolerance and one row of equal), ``rows`` (counts at most one apart), ``key`` (the shard follows from id and shard
count alone, and one more shard takes rows only into itself: highest random weight). A null text has no bytes; null ids hash like
any value. Columns named like those that are made here are replaced. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import small, stored

SHARDS = 16
#: How far a splitter may lie off its target, as a share of a shard's size.
TOLERANCE = 0.002
#: Bits by which a round narrows an interval; rows in a bin, about.
RADIX, BIN_ROWS = 10, 50_000
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_k", "_d", "_t", "_bin", "_first"]
_LEAST = -(1 << 63)


def splitters(rows: DataFrame, n: int, weight: str, tolerance: float) -> list[tuple[int, int, int]]:
    """n - 1 keys (k, d, t); a row belongs behind each that is at most its own, t being the number of rows of that very key that come before. rows: _k, _d and the weight, stored."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    allowed = tolerance * total / n
    done: dict[int, tuple[int, int, int]] = {}
    # splitter: (level, the first key once it is known, prefix of the open interval, its bits, weight below it)
    live = {i: ("_k", None, None, 64, 0) for i in range(1, n)}
    while live:
        by = {}
        for i, (col, k, start, bits, _) in live.items():
            by.setdefault((col, bits), set()).add((k, start))
        counts = {}
        for (col, bits), spots in by.items():
            to = max(bits - RADIX, 0)
            part = rows
            if col == "_d":
                part = part.where(F.col("_k").isin([k for k, _ in spots]))
            if bits < 64:
                part = part.where(F.shiftright(col, bits).isin([s for _, s in spots]))
            k = F.col("_k") if col == "_d" else F.lit(None).cast("long")
            for r in part.groupBy(k.alias("k"), F.shiftright(col, to).alias("p")).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect():
                start = r["p"] >> (bits - to) if bits < 64 else None
                counts.setdefault((col, bits, r["k"], start), []).append((r["p"], r["w"], r["n"]))
        then = {}
        for i, (col, k, start, bits, below) in live.items():
            to, goal, edge = max(bits - RADIX, 0), i * total // n, below
            parts = sorted(counts.get((col, bits, k, start), []))
            key = lambda p: (p << to, _LEAST) if col == "_k" else (k, p << to)  # noqa: E731, B023
            for p, w, rows_in in parts:
                if edge + w > goal or p == parts[-1][0]:
                    if abs(goal - edge) <= allowed:
                        done[i] = (*key(p), 0)
                    elif abs(edge + w - goal) <= allowed:
                        done[i] = (*_next(key(p), col, to), 0)
                    elif to:
                        then[i] = (col, k, p, to, edge)
                    elif col == "_k":
                        then[i] = ("_d", p, None, 64, edge)
                    else:  # rows of one text and id, all of one weight: as many as fit come before
                        done[i] = (*key(p), round((goal - edge) / (w / rows_in)))
                    break
                edge += w
            else:
                done[i] = (_LEAST, _LEAST, 0)
        live = then
    return [done[i] for i in range(1, n)]


def _next(key: tuple[int, int], col: str, bits: int) -> tuple[int, int]:
    """The key just behind a part of 2**bits keys."""
    k, d = key
    if col == "_k":
        return (k + (1 << bits), _LEAST) if k + (1 << bits) < 1 << 63 else ((1 << 63) - 1, (1 << 63) - 1)
    return (k, d + (1 << bits)) if d + (1 << bits) < 1 << 63 else ((k + 1, _LEAST) if k + 1 < 1 << 63 else ((1 << 63) - 1, (1 << 63) - 1))


def by_key(n: int) -> Column:
    """The shard of the largest of n hashes of the id."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64("doc_id", F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)]))
    return best["i"]


def sharded(docs: DataFrame, n: int = SHARDS, law: str = "bytes", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` (doc_id, text and more) with size, text_crc32, law, shard, slot and grown_shard; own columns of these names are replaced."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop(*OWN).withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "_k": F.xxhash64(text), "_d": F.xxhash64("doc_id"), "law": F.lit(law)})
    grown, found = F.lit(None).cast("int"), []
    if law == "key":
        shard, grown = by_key(n), by_key(n + 1)
        keys = docs.select("_k", "_d", "doc_id")
    else:
        keys = stored(docs.select("_k", "_d", "size", F.lit(1).cast("long").alias("one")), "keys")
        found = splitters(keys, n, "size" if law == "bytes" else "one", tolerance if law == "bytes" else 0.0)
        shard = F.lit(0)
        for k, d, t in found:
            shard = shard + ((F.col("_k") > k) | ((F.col("_k") == k) & ((F.col("_d") > d) | ((F.col("_d") == d) & (F.col("_t") > t))))).cast("int")
    ties = {(k, d) for k, d, t in found if t}
    bins = max(1, -(-keys.count() // (n * BIN_ROWS)))
    placed = lambda df: numbered(df, ties).withColumn("shard", shard).withColumn("_bin", F.pmod(F.xxhash64("_d", "_k", "_t"), F.lit(bins)).cast("int"))
    sizes = placed(keys).groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(stored(sizes.withColumn("_first", first).drop("_n"), "starts"))
    w = Window.partitionBy("shard", "_bin").orderBy("_k", "_d", "_t")
    out = placed(docs).join(starts, ["shard", "_bin"]).withColumn("slot", F.col("_first") + F.row_number().over(w) - 1)
    return out.withColumn("grown_shard", grown).drop("_bin", "_first", "_k", "_d", "_t")


def numbered(df: DataFrame, ties: set[tuple[int, int]]) -> DataFrame:
    """``df`` with _t: 1, but for rows whose key a splitter divides, which are counted."""
    if not ties:
        return df.withColumn("_t", F.lit(1))
    tied = F.lit(False)
    for k, d in ties:
        tied = tied | ((F.col("_k") == k) & (F.col("_d") == d))
    counted = df.where(tied).withColumn("_t", F.row_number().over(Window.partitionBy("_k", "_d").orderBy("_k")))
    return df.where(~tied).withColumn("_t", F.lit(1)).unionByName(counted)


def write(docs: DataFrame, path: str, **more) -> None:
    """The shards as Parquet, a folder for each, rows in the order of slots within each file."""
    sharded(docs, **more).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "grown_shard")
