"""What the operators of this subpackage share: stored tables, size checks, hashing of words and connected components."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids and a few numbers may be broadcast (about 4 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Stored:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str, *by: str):
        """by: columns that get a folder for each value."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and reread."""
    return Stored(df, tag).read()


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows. ``df`` should be a stored table: counting it is then free."""
    return F.broadcast(df) if df.count() <= rows else df


# --- words and their hashes, over whole Arrow batches -------------------------------------------------------------

_MASK = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    b[65:91] += np.uint64(32)  # A-Z count as a-z
    return mix((b + np.uint64(1)) * _GOLD) | np.uint64(1)


_LETTER = _letters()
#: Bytes beyond which a word is hashed by BLAKE2 (bytes.lower() changes A-Z alone).
LONG = 64
#: Bytes that are no part of a word: the six blanks of ASCII, or all of ASCII but letters and digits.
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Words:
    """The words of some texts.

    ``doc`` gives the index of each word's text, ``hash`` its 64-bit hash (A-Z and a-z alike), ``start`` and ``end`` its
    bytes in ``data``, ``first`` the first word of each text (one entry more than texts), ``base`` each text's first byte.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray):
        n = len(data)
        gap = apart[data] if n else np.zeros(0, bool)
        inside = ~gap
        start, end = inside.copy(), inside.copy()
        if n:
            start[1:] &= gap[:-1]
            end[:-1] &= gap[1:]
            cut = offsets[(offsets < n) & (offsets > 0)]
            start[cut] = inside[cut]
            end[cut - 1] = inside[cut - 1]
        self.data, self.base = data, offsets
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _GOLD)
        for k in np.flatnonzero(self.end - self.start > LONG):  # a polynomial modulo 2**64 has known collisions between long words
            self.hash[k] = np.frombuffer(hashlib.blake2b(data[self.start[k] : self.end[k]].tobytes().lower(), digest_size=8).digest(), np.uint64)[0]
        self._sums, self._down = sums, down
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def beginnings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the first k bytes, index of the word) of the words of more than k bytes."""
        at = np.flatnonzero(self.end - self.start > k)
        s = self.start[at]
        return mix((self._sums[s + k] - self._sums[s]) * self._down[s] ^ _GOLD), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of each run of k words within one text, in order."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = self.hash[at] + np.uint64(k)
        for j in range(1, k):
            h = mix(h * _GOLD + self.hash[at + j])
        return h, at


def whole(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole sequence of words: that of shingles() for as many words."""
    h = hashes[:1] + np.uint64(len(hashes))
    for j in range(1, len(hashes)):
        h = mix(h * _GOLD + hashes[j : j + 1])
    return h[0]


def texts(column: pa.Array, apart: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) of pieces of about ``limit`` bytes of a column of strings; a text is never split. Nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        raise TypeError(f"a column of strings is needed, not {column.type}")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # what a null points at is undefined
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if sizes.sum() != offsets[-1] - offsets[0]:
            yield from texts(column.fill_null(""), apart, limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], apart)
        lo = hi


def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists: values[cuts[i]:cuts[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, cuts) of rows that come sorted by their first ``keys`` columns (numbers): cuts[i]:cuts[i + 1] are all the rows of one key."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        ids = [b.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        if len(new):
            yield b.slice(0, int(new[-1])), np.concatenate([[0], new])
            b = b.slice(int(new[-1]))
        rest = b
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def pairs_within(cuts: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of all pairs of rows of one segment, about ``most`` at a time."""
    end = np.repeat(cuts[1:], np.diff(cuts))
    n = end - np.arange(len(end)) - 1
    total = np.concatenate([[0], np.cumsum(n)])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], n[lo:hi])
        lo = hi


# --- connected components -----------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long): component is the smallest node that can be reached.

    Large-star and small-star rounds, each one aggregation with map-side sums and one join that Spark can split by skew;
    every round is written to the shared folder. Ends when a round changes nothing; nulls and loops are dropped.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = Stored(edges, "links"), None
    for _ in range(rounds):
        e = now.read()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_ = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small_, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        seen = Observation()
        then = Stored(star.select("e.*").where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "links")
        sign = seen.get
        now.drop()
        now = then
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    e = now.read()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
