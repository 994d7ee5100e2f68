"""Exact top-k search with a bit-sliced index.

Rows are dealt to blocks; a block's index has, for each component, the bits of its values (less the block's least value) as bitmaps
over the block's rows. For a query every component's bitmaps are added as often as the query's bits say: bitmaps of equal weight
go through full adders three by three until one is left, their carries join the next weight. Negative factors add the
complement. The top k are then taken from the most significant sum bitmap downward; rows that tie at the boundary go by id. What a block
chose is scored once more with whole numbers, and blocks are merged by score.

Vectors that are null or hold a null or a number that isn't finite take no part, nor do rows without an id. Shorter vectors count as filled up with zeros.
Vectors whose scores might not fit 62 bits (number of components times both largest ones) raise an error. Rows that share the query's id are its own; repeated query rows (same id and vector) count
once. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a block, queries in a pack, packs that meet a block in one group: these bound what one group holds.
BLOCK, PACK, PACKS = 16_384, 128, 8
LARGEST = 1 << 62


class Slices:
    def __init__(self, x: np.ndarray):
        """x: whole numbers, one row each."""
        n, dims = x.shape
        self.n, self.words = n, (n + 63) // 64
        self.low = x.min(0)
        u = (x - self.low).astype(np.uint64)
        self.bits = [int(v).bit_length() for v in u.max(0)]
        self.dim = np.repeat(np.arange(dims), self.bits)
        self.bit = np.concatenate([np.arange(b) for b in self.bits]).astype(np.int64) if sum(self.bits) else np.zeros(0, np.int64)
        rows = [self.pack((u[:, d] >> np.uint64(b)) & np.uint64(1)) for d, b in zip(self.dim, self.bit, strict=True)]
        plain = np.array(rows, np.uint64).reshape(len(rows), self.words)
        self.all = self.pack(np.ones(n, np.uint64))
        self.maps = np.concatenate([plain, ~plain & self.all])

    def pack(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros(self.words * 64, np.uint8)
        full[: len(flags)] = flags
        return np.packbits(full, bitorder="little").view(np.uint64)

    def total(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of sum |q_d| * (value or complement), least significant first."""
        a = np.abs(q)
        by, weight = [], []
        row = np.arange(len(self.dim)) + np.where(q[self.dim] < 0, len(self.dim), 0)
        for j in range(int(a.max()).bit_length() if len(a) else 0):
            some = np.flatnonzero(a[self.dim] >> j & 1)
            by.append(row[some])
            weight.append(self.bit[some] + j)
        if not by:
            return []
        by, weight = np.concatenate(by), np.concatenate(weight)
        out, carried, w = [], [], 0
        top = weight.max() if len(weight) else -1
        while w <= top or carried:
            stack = np.concatenate([self.maps[by[weight == w]], *carried])
            carried = []
            while len(stack) > 2:
                m = len(stack) // 3
                x, y, z = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                odd = x ^ y
                carried.append((x & y) | (z & odd))
                stack = np.concatenate([odd ^ z, stack[3 * m :]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def best(self, total: list[np.ndarray], k: int, own: np.ndarray) -> np.ndarray:
        """Rows of the k largest sums but for own; rows come in order of id, so ties go to the first."""
        sure, tied = np.zeros(self.words, np.uint64), self.all & ~own
        for bits in reversed(total):
            more = sure | (tied & bits)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied = tied & bits
            else:
                sure, tied = more, tied & ~bits
                if n == k:
                    return self.rows(sure)
        return np.concatenate([self.rows(sure), self.rows(tied)[: k - int(np.bitwise_count(sure).sum())]])

    def rows(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _stack(lists: list, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of ``vectors`` with the largest inner product of floor(scale * component)."""

    def whole(df):
        fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("x"))

    v = whole(vectors)
    q = whole(queries).dropDuplicates(["vec_id", "x"])
    far = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    n, dims, most = v.agg(F.count("*"), F.max(F.size("x")), far).first()
    n_q, dims_q, most_q = q.agg(F.count("*"), F.max(F.size("x")), far).first()
    if max(dims or 0, dims_q or 0) * max(most or 0, 1) * max(most_q or 0, 1) > LARGEST:
        raise ValueError("components are too large for exact scores")
    dims, blocks, packs = max(dims or 0, dims_q or 0, 1), max(1, math.ceil(n / block)), max(1, math.ceil(n_q / PACK))
    groups = math.ceil(packs / PACKS)
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", "x", F.lit(salt)), F.lit(n)).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        return pa.table({"at": table["at"][:1], "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "x": pa.array([_stack(table["x"].to_pylist(), dims).tobytes()], pa.binary())})

    packed = lambda df, n, salt: df.withColumn("at", spread(n, salt)).groupBy("at").applyInArrow(pack, "at int, ids binary, x binary")
    # every pack of queries meets every block: a grid of groups, each of one block and at most PACKS packs
    left = packed(v, blocks, 1).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.col("at").alias("block"), "group", "ids", "x")
    right = packed(q, packs, 2).withColumn("group", F.expr(f"at div {PACKS}").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", "group", "ids", "x")

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and asks.num_rows:
            ids = np.frombuffer(rows["ids"][0].as_py(), np.int64)
            x = np.frombuffer(rows["x"][0].as_py(), np.int64).reshape(len(ids), dims)
            index = Slices(x)
            for qi, qx in zip(asks["ids"].to_pylist(), asks["x"].to_pylist(), strict=True):
                qi = np.frombuffer(qi, np.int64)
                for me, ask in zip(qi, np.frombuffer(qx, np.int64).reshape(len(qi), dims), strict=True):
                    lo, hi = np.searchsorted(ids, [me, me + 1])
                    own = np.zeros(len(ids), np.uint8)
                    own[lo:hi] = 1
                    best = index.best(index.total(ask), k, index.pack(own))
                    out["query_id"].append(np.full(len(best), me))
                    out["vec_id"].append(ids[best])
                    out["score"].append(x[best] @ ask)
        return pa.table({c: pa.array(np.concatenate(a) if a else [], pa.int64()) for c, a in out.items()})

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(v, v.where("vec_id % 20 = 0"))


#: A row has the slices of its own block only, so the plain sum of products must agree.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as (select vec_id, unnest(x) x, generate_subscripts(x, 1) d from v),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(sum(q.x * c.x) as bigint) score from e q join e c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by all),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
