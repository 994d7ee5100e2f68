"""Benchmark decontamination: a prefix-filtered set join of item windows against whole documents.

Words are runs of ASCII letters and digits and of all other characters, A-Z lower-cased. A window is ``size`` consecutive words of an
item; an item of fewer words, but not none, is one window. Every window is a set of short shingles; it can only be contained
whole if its rarest shingle occurs, so that one shingle is its prefix. Rarity is counted over all documents. A document is
probed by its shingles that are some window's prefix; length and position bounds drop windows that would leave the document,
and what remains is verified word by word.

Nulls, in either table's text: no words. Empty tables: no items leave every document clean; no documents give no rows.
Item ids may be of any type and are compared as strings; repeated ones count once in a document, null ones hit but are left out of the list of ids. Ties in rarity go to the smaller hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import MARKS, texts, whole

#: UTF-8 bytes of item texts that one pass over the documents takes along; a larger benchmark is joined in blocks of this size.
BLOCK_BYTES = 16 << 20
SHINGLE = 3
#: A document counts as contaminated if at least one word in so many is hit.
ONE_IN = 20


class Index:
    """Windows of some items, by prefix shingle."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        windows: dict[bytes, list] = {}
        for item, text in items:
            for _, _, w in texts(pa.array([text], pa.string()), MARKS):
                n = len(w.hash)
                for i in range(max(1, n - size + 1) if n else 0):
                    h = w.hash[i : i + size]
                    windows.setdefault(h.tobytes(), [h, set()])[1].add(item)
        self.words = [h for h, _ in windows.values()]
        self.items = [sorted(s - {None}) for _, s in windows.values()]
        self.length = np.array([len(h) for h in self.words], np.int64)
        #: for each window its shingles' hashes
        self.parts = [np.array([whole(h[j : j + k]) for j in range(len(h) - k + 1)]) for h in self.words for k in [min(SHINGLE, len(h))]]
        self.tokens = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint64)
        self.kinds = sorted({min(SHINGLE, int(n)) for n in self.length})

    def order(self, counts: np.ndarray) -> None:
        """counts: how often each of ``tokens`` occurs in all documents."""
        token, offset = [], []
        for p in self.parts:
            at = np.searchsorted(self.tokens, p)
            j = np.lexsort((p, counts[at]))[0]
            token.append(p[j])
            offset.append(j)
        by = np.argsort(np.array(token, np.uint64), kind="stable")
        self.prefix = np.array(token, np.uint64)[by]
        self.offset, self.window = np.array(offset, np.int64)[by], by
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.keys = np.unique(self.prefix)

    def found(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the texts of w."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.kinds:
            h, at = w.shingles(k)
            hit = member(h, self.keys)
            h, at = h[hit], at[hit]
            lo, hi = np.searchsorted(self.prefix, h, "left"), np.searchsorted(self.prefix, h, "right")
            row = np.repeat(np.arange(len(h)), hi - lo)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            start, window = at[row] - self.offset[entry], self.window[entry]
            doc = w.doc[at[row]]
            fits = (np.minimum(self.length[window], SHINGLE) == k) & (start >= w.first[doc]) & (start + self.length[window] <= w.first[doc + 1])
            start, window = start[fits], window[fits]
            for j in range(self.size):
                live = self.length[window] > j
                same = np.ones(len(start), bool)
                same[live] = w.hash[start[live] + j] == self.flat[self.at[window[live]] + j]
                start, window = start[same], window[same]
            starts.append(start)
            windows.append(window)
        return np.concatenate(starts), np.concatenate(windows)


def member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array keys."""
    if not len(keys) or not len(h):
        return np.zeros(len(h), bool)
    low = np.zeros(1 << 16, bool)
    low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
    ok = np.zeros(len(h), bool)
    ok[at] = keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]
    return ok


def count_tokens(docs: DataFrame, index) -> np.ndarray:
    """How often each of the index's tokens occurs in all documents; as many numbers as the benchmark's block has shingles."""

    def part(batches):
        ix = index.value
        n = np.zeros(len(ix.tokens), np.int64)
        for batch in batches:
            for _, _, w in texts(batch.column(0), MARKS):
                for k in ix.kinds:
                    h, _ = w.shingles(k)
                    n += np.bincount(np.searchsorted(ix.tokens, h[member(h, ix.tokens)]), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["token", "n"])

    rows = docs.select("text").mapInArrow(part, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(index.value.tokens), np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def blocks(benchmark: DataFrame, block_bytes: int):
    """The items in lists of about block_bytes of text, one after the other: the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    out, size = [], 0
    for r in items.toLocalIterator():
        if out and size + len(r[1].encode()) > block_bytes:
            yield out
            out, size = [], 0
        out.append((r[0], r[1]))
        size += len(r[1].encode())
    if out:
        yield out


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, covered (bits of the words inside occurrences, packed) and items (their item ids, distinct).

    The benchmark goes to the workers in blocks of at most ``block_bytes`` of text (or one item). Each further block is one more scan that counts its
    shingles and one more narrow step, without an exchange, that adds to covered and items; a worker holds one block's index for each step.
    """
    spark: SparkSession = docs.sparkSession
    clash = {"n_words", "n_hit", "covered", "items"} & set(docs.columns)
    if clash:
        docs = docs.drop(*clash)
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "n_hit": F.lit(None).cast("long"), "covered": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    any_block = False
    for items in blocks(benchmark, block_bytes):
        any_block = True
        index = Index(items, size)
        first = spark.sparkContext.broadcast(index)
        index.order(count_tokens(docs, first))
        out = out.mapInArrow(_marker(spark.sparkContext.broadcast(index)), out.schema)
    if not any_block:
        out = out.mapInArrow(_marker(None), out.schema)
    return out


def _marker(index):
    def mark(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            was = {c: batch.column(batch.schema.get_field_index(c)) for c in ("covered", "items")}
            n_words, covered, found = [], [], []
            for lo, hi, w in texts(text, MARKS):
                n = np.diff(w.first)
                start, window = index.value.found(w) if index else (np.zeros(0, np.int64),) * 2
                step = np.zeros(len(w.hash) + 1, np.int64)
                if len(start):
                    np.add.at(step, start, 1)
                    np.add.at(step, start + index.value.length[window], -1)
                hit = np.cumsum(step)[:-1] > 0
                docs = w.doc[start]
                by = np.argsort(docs, kind="stable")
                cuts = np.searchsorted(docs[by], np.arange(hi - lo + 1))
                n_words.append(n)
                for i in range(hi - lo):
                    old = was["covered"][lo + i].as_py()
                    mine = cuts[i + 1] > cuts[i]
                    bits = np.packbits(hit[w.first[i] : w.first[i + 1]]).tobytes() if mine else None
                    if old and bits:
                        bits = (np.frombuffer(old, np.uint8) | np.frombuffer(bits, np.uint8)).tobytes()
                    covered.append(bits or old)
                    ids = {x for k in window[by[cuts[i] : cuts[i + 1]]] for x in index.value.items[k]} if mine else set()
                    found.append(sorted((ids | set(was["items"][lo + i].as_py() or ())) - {None}))
            new = {"n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), "covered": pa.array(covered, pa.binary()), "n_hit": pa.array([int.from_bytes(b or b"").bit_count() for b in covered], pa.int64()), "items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(j)) for j, c in enumerate(batch.schema.names)], batch.schema.names)

    return mark


def report(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and contaminated."""
    out = hits(docs, benchmark, size, block_bytes)
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).drop("covered")


def clean(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return report(docs, benchmark, **more).where(~F.col("contaminated")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.concat_ws(",", F.array_sort("items"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


#: Rows of words and of windows, joined by the window's first word and verified as whole lists.
SQL = r"""
with lower as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from lower),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
win as (select distinct item_id, w[i:i + 12] g from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
heads as (select distinct g[1] head, len(g) n from win),
pos as (select doc_id, i, n, w[i:i + n - 1] g from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d) p join heads on head = w[i] where i + n - 1 <= len(w)),
hit as (select doc_id, i, len(pos.g) n, item_id from pos join win on win.g = pos.g),
cover as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from hit) group by doc_id),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hit group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cover using (doc_id) left join items using (doc_id)
"""
