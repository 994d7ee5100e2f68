"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a threshold, by a grouped prefix join.

Words are runs of anything but the six blanks of ASCII, A-Z lower-cased. A document's set holds its distinct n-word shingles; with fewer words, the
whole sequence as one. Two documents link when 100 * |x & y| >= percent * |x | y|. The steps:

1. A sketch of fixed size counts in how many documents each shingle's bucket occurs, over all documents; shingles are ordered by it, rare
   first, then by hash. Any order that is the same for all documents gives right results, so shared buckets cost only time.
2. Documents with equal sets are one node. Nodes of equal size and prefix are one group; only groups are posted under the
   prefix's shingles. A shingle under which one group alone is posted is dropped.
3. A round of stars: in every list the group with the least hash is compared with the rest, within the bounds of size and position, and in every
   group the least node with the rest. What is verified on whole sets is linked, and pairs of one component need no comparison any more.
4. Lists that still hold several components are expanded to the groups' members and dealt over blocks; each two blocks are one piece of work, in which
   pairs are held against the bounds and against parity bits, and only those that pass come out of it: first the closest pair of each two components,
   then, when those have been verified and the components joined, every pair that is left. So no two linked sets end in different
   components, and no pair is emitted that the bits rule out. A pair of bits differs in at most as many places as the two sets.

Comparisons in step 4 are quadratic in the members of a list that stays open (a large family of copies just below the threshold); an exact answer
needs them. Shingles are 64-bit hashes. Empty texts, texts without words and nulls have empty sets and link with nothing; a null doc_id is returned with a null component.
Repeated rows and ties share a node. Columns of the same names in ``docs`` are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import _GOLD, BLANKS, Stored, components, free, lists, matrix, mix, pairs_within, segments, signed, small, texts, whole

N, PERCENT = 4, 85
#: Counters of the sketch: 4 MB whatever the input; each of its CHUNKS rows goes through the shuffle alone.
BUCKETS, CHUNKS = 1 << 20, 64
#: Bits of the signature that goes along with postings; rows of a list that meet at once; passes that compare the closest pairs of components only.
BITS, BLOCK, CLOSEST = 1024, 1000, 1


def sets(column: pa.Array, n: int):
    """(from row, to row, [sorted distinct hashes of each text]) of pieces of a column."""
    for lo, hi, w in texts(column, BLANKS):
        h, at = w.shingles(n)
        cut = np.searchsorted(at, w.first)
        size = np.diff(w.first)
        yield lo, hi, [np.unique(h[cut[i] : cut[i + 1]]) if size[i] >= n else np.array([whole(w.hash[w.first[i] : w.first[i + 1]])], np.uint64) if size[i] else np.zeros(0, np.uint64) for i in range(hi - lo)]


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """In how many documents each bucket's shingles occur."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, each in sets(b.column(0), n):
                if each:
                    total += np.bincount((np.concatenate(each) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        parts = total.astype(np.uint32).reshape(CHUNKS, -1)
        for i in np.flatnonzero(parts.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], ["chunk", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(part.as_buffer(), np.uint32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.int64)
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(part, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["chunk", "n"])

    partial = docs.select("text").mapInArrow(count, "chunk int, n binary")
    out = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.uint32)
    for r in partial.repartition(CHUNKS // 4, "chunk").mapInArrow(add, "chunk int, n binary").collect():
        out[r["chunk"]] += np.frombuffer(r["n"], np.uint32)
    return out.reshape(-1)


def prefix(size: int, percent: int) -> int:
    """How many first shingles a set must post: of two sets that link, these overlap."""
    return size - -(-size * percent // 100) + 1 if size else 0


def keyed(docs: DataFrame, counts, n: int, percent: int) -> DataFrame:
    """(doc_id, size, node, grp, prefix, sig, bits): node stands for the whole set, grp for its size and prefix; bits only where they are longer than sig."""
    counts = docs.sparkSession.sparkContext.broadcast(counts)

    def part(batches):
        for b in batches:
            for lo, hi, each in sets(b.column(1), n):
                node, grp, head, sig, bits = [], [], [], [], []
                for s in each:
                    order = s[np.lexsort((s, counts.value[(s >> np.uint64(44)).astype(np.int64)]))][: prefix(len(s), percent)]
                    head.append(signed(order))
                    sig.append(parity(s, BITS))
                    bits.append(parity(s, m) if (m := 1 << (2 * len(s) - 1).bit_length()) > BITS and len(s) else None)
                    node.append(_hash(s) if len(s) else None)
                    grp.append(_hash(np.concatenate([order, [np.uint64(len(s))]])) if len(s) else None)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in head])])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(s) for s in each], pa.int64()), pa.array(node, pa.int64()), pa.array(grp, pa.int64()), lists(np.concatenate(head), cuts, pa.int64()), pa.array(sig, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "size", "node", "grp", "prefix", "sig", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(part, "doc_id long, size long, node long, grp long, prefix array<long>, sig binary, bits binary")


def parity(s: np.ndarray, m: int) -> bytes:
    """m bits, of which each element of a set flips one: two sets' bits differ in at most as many places as the sets."""
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def allowed(z, w, percent: int):
    """In how many elements two sets of sizes z and w that link may differ."""
    return z + w + 2 * (-percent * (z + w) // (100 + percent))


def may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose parity bits don't rule out that they link; nothing that links is lost."""
    of = lambda side, z, bits: nodes.select(F.col("node").alias(side), F.col("size").alias(z), F.coalesce("bits", "sig").alias(bits))
    both = pairs.select("a", "b").join(of("a", "z", "x"), "a").join(of("b", "w", "y"), "b").select("a", "b", "z", "w", "x", "y")

    def part(batches):
        for b in batches:
            keep = []
            for z, w, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= allowed(z, w, percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(part, "a long, b long")


def _hash(s: np.ndarray) -> int:
    """Of a set in its order."""
    x = mix(s + np.arange(1, len(s) + 1, dtype=np.uint64) * _GOLD)
    return int(mix(np.array([x.sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].view(np.int64))


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> Stored:
    """The pairs (a, b) of nodes whose whole sets link. The sets are made anew from the texts of the nodes' first documents."""
    pairs = Stored(may_link(pairs, nodes, percent), "pairs")
    sides = pairs.read().select(F.col("a").alias("node")).unionByName(pairs.read().select(F.col("b").alias("node"))).distinct()
    ids = Stored(nodes.select("doc_id", "node").join(sides, "node"), "ids")
    texts_ = docs.select(F.col("doc_id").cast("long"), "text").join(small(ids.read()), "doc_id").select("node", "text")
    # another row with that id, but another text, is another node; repeated rows give one set
    found = Stored(texts_.mapInArrow(_hashed(n), "node long, s binary"), "sets")
    once = found.read().dropDuplicates(["node"])
    both = once.select(F.col("node").alias("b"), F.col("s").alias("t")).join(small(pairs.read()), "b").join(once.select(F.col("node").alias("a"), "s"), "a").select("a", "b", "s", "t")

    def part(batches):
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = Stored(both.mapInArrow(part, "a long, b long"), "links")
    for done in (pairs, ids, found):
        done.drop()
    free(docs.sparkSession)
    return out


def fits(size, pos, z, p, percent: int):
    """Of sets that link, the smaller is long enough, and what can still follow the shared shingle suffices. Columns or arrays."""
    low, high, least = (F.least, F.greatest, F.ceil) if isinstance(size, F.Column) else (np.minimum, np.maximum, np.ceil)
    return (low(size, z) * 100 >= percent * high(size, z)) & (low(size - pos, z - p) + low(pos, p) >= least(percent * (size + z) / (100.0 + percent)))


def across(rows: DataFrame, label: DataFrame, percent: int, closest: bool) -> DataFrame:
    """The pairs (a, b) of nodes of one list and two components that may link; of each two components the closest one, or all."""
    dealt = rows.join(small(label), "node", "left").withColumn("c", F.coalesce("component", "node")).withColumn("b", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("b", "j").alias("b1"), F.greatest("b", "j").alias("b2"), "b", "node", "c", "size", "pos", "sig")
    dealt = dealt.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")

    def part(batches):
        for t, cuts in segments(batches, 3):
            b1, b2, b, node, c, size, pos = (t.column(k).to_numpy() for k in range(1, 8))
            sig = matrix(t.column(8))
            for i, j in pairs_within(cuts):
                ok = (c[i] != c[j]) & ((b[i] != b[j]) | (b1[i] == b2[i]))
                i, j = i[ok], j[ok]
                ok = fits(size[i], pos[i], size[j], pos[j], percent)
                i, j = i[ok], j[ok]
                spare = allowed(size[i], size[j], percent) - np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64)
                i, j, spare = i[spare >= 0], j[spare >= 0], spare[spare >= 0]
                x, y = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
                if closest and len(i):
                    by = np.lexsort((-spare, y, x))
                    first = np.ones(len(by), bool)
                    first[1:] = (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1])
                    i, j, x, y, spare = (v[by[first]] for v in (i, j, x, y, spare))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), x, y, spare)], ["a", "b", "x", "y", "spare"])

    pairs = dealt.mapInArrow(part, "a long, b long, x long, y long, spare long")
    if closest:
        return pairs.groupBy("x", "y").agg(F.max(F.struct("spare", "a", "b")).alias("best")).select("best.a", "best.b")
    return pairs.select("a", "b").distinct()


def linked(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> list[Stored]:
    """The links (a, b) of nodes that join every component. nodes: node, grp, size, prefix, sig, bits and doc_id, stored."""
    crowded = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").select("grp", "head")
    rest = Stored(nodes.select("grp", "node").join(crowded, "grp").where("node <> head"), "rest")  # all but the least node of a group
    posted = nodes.join(small(rest.read().select("node")), "node", "left_anti").select("grp", "node", F.col("size").cast("int"), F.posexplode("prefix").alias("pos", "token"))
    busy = Stored(posted.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x < y").select("token"), "busy")
    lists_ = Stored(posted.join(busy.read(), "token").select("token", "grp", "node", "size", "pos"), "lists")
    busy.drop()
    free(docs.sparkSession)

    lead = lists_.read().groupBy("token").agg(F.min(F.struct(F.xxhash64("grp"), F.col("grp").alias("g"), F.col("node").alias("m"), F.col("size").alias("z"), F.col("pos").alias("p"))).alias("lead"))
    star = lists_.read().join(lead, "token").where(F.col("grp") != F.col("lead.g")).where(fits(F.col("size"), F.col("pos"), F.col("lead.z"), F.col("lead.p"), percent))
    pairs = star.select(F.least("node", "lead.m").alias("a"), F.greatest("node", "lead.m").alias("b")).distinct().unionByName(rest.read().select(F.col("head").alias("a"), F.col("node").alias("b")))
    tried = [verify(pairs, docs, nodes, n, percent)]
    label = Stored(components(tried[0].read()), "labels")

    # lists by node, and one for each group of several nodes; those of one component go
    more = rest.read().join(nodes.select("node", "size"), "node").select(F.col("grp").alias("token"), "grp", "node", F.col("size").cast("int"), F.lit(0).alias("pos"))
    more = more.unionByName(more.join(rest.read().select("node", "head"), "node").select("token", "grp", F.col("head").alias("node"), "size", "pos").distinct())
    rows = lists_.read().unionByName(lists_.read().drop("node").join(small(rest.read().select("grp", "node")), "grp").select("token", "grp", "node", "size", "pos")).unionByName(more)
    c = F.coalesce("component", "node")
    open_ = rows.join(small(label.read()), "node", "left").groupBy("token").agg(F.min(c).alias("x"), F.max(c).alias("y"), F.count("*").alias("n")).where("x < y")
    open_ = Stored(open_.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    rows = Stored(rows.join(open_.read(), "token").join(nodes.select("node", "sig"), "node").select("token", "node", "size", "pos", "blocks", "sig"), "rows")
    for done in (lists_, rest, open_):
        done.drop()
    for r in range(CLOSEST + 1):
        free(docs.sparkSession)
        tried.append(verify(across(rows.read(), label.read(), percent, r < CLOSEST), docs, nodes, n, percent))
        label.drop()
        if r < CLOSEST:
            label = Stored(components(_all(tried)), "labels")
    rows.drop()
    return tried


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_verified (links of its set that were verified, as many as the components need) of every row of
    ``docs`` (doc_id, text); node and row_node tell equal sets and components apart where ids repeat."""
    keys = Stored(keyed(docs, sketch(docs, n), n, percent), "keys")
    first = lambda *names: [F.first(c).alias(c) for c in names]  # noqa: E731  equal in all rows of a node
    nodes = Stored(keys.read().where("node is not null").groupBy("node").agg(*first("grp", "size", "prefix", "sig", "bits"), F.min("doc_id").alias("doc_id")), "nodes")
    tried = linked(docs, nodes.read(), n, percent)
    labels = Stored(components(_all(tried)), "labels")
    ends = _all(tried).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_verified"))
    label = Stored(nodes.read().select("node", "doc_id").join(labels.read(), "node", "left").join(ends, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("class"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified")), "label")
    least = label.read().groupBy("class").agg(F.min("doc_id").alias("component_id"))
    named = label.read().join(least, "class").select("node", "class", "component_id", "n_verified")
    out = keys.read().select("doc_id", F.col("size").alias("n_shingles"), "node").join(named, "node", "left")
    out = Stored(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"), "node", "class"), "joined")
    for done in (keys, nodes, labels, label, *tried):
        done.drop()
    return out.read()


def _all(tried: list[Stored]) -> DataFrame:
    out = tried[0].read()
    for t in tried[1:]:
        out = out.unionByName(t.read())
    return out


def _hashed(n: int):
    """The sets of texts as bytes, where they are those of the node that was asked for."""

    def part(batches):
        for b in batches:
            for lo, hi, each in sets(b.column(1), n):
                node = b.column(0)[lo:hi]
                mine = pa.array([k == _hash(s) for k, s in zip(node.to_pylist(), each, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in each], pa.binary())], ["node", "s"]).filter(mine)

    return part


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The row with the smallest doc_id of each component, with its own columns; of rows that share id and set, any one. Rows with empty sets stay, and
    so do those without an id."""
    columns = docs.columns
    tagged = docs.withColumn("__id", F.col("doc_id").cast("long"))
    rows = join(docs.select("doc_id", "text"), n, percent).where("doc_id is not null")
    full = rows.where("node is not null")
    kept = full.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("k")).select("k.*")
    # an id may stand for several rows: only then their sets are told apart by their texts
    twice = Stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")), "twice")
    gone = full.select("doc_id", "node").join(kept, ["doc_id", "node"], "left_anti").select(F.col("doc_id").alias("__id"))
    gone = Stored(gone.join(small(twice.read()), "__id", "left_anti").unionByName(twice.read()), "gone")
    out = tagged.join(small(gone.read()), "__id", "left_anti").select(*columns)
    if twice.read().isEmpty():
        return out
    again = tagged.join(small(twice.read()), "__id", "left_semi")
    again = again.join(noded(again, n).withColumnRenamed("text", "__text"), (F.col("__id") == F.col("__of")) & (F.col("text") == F.col("__text")), "left")
    chosen = Stored(kept.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")), "kept")
    some = again.where("__node is not null").join(small(chosen.read()), ["__id", "__node"], "left_semi").dropDuplicates(["__id", "__node"])
    return out.unionByName(again.where("__node is null").select(*columns)).unionByName(some.select(*columns))


def noded(rows: DataFrame, n: int) -> DataFrame:
    """(__of, text, __node) of the distinct ids and texts of some rows; the node as in keyed()."""

    def part(batches):
        for b in batches:
            for lo, hi, each in sets(b.column(1), n):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([_hash(s) if len(s) else None for s in each], pa.int64())], ["__of", "text", "__node"])

    return rows.select("__id", "text").distinct().mapInArrow(part, "__of long, text string, __node long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("node", "class")
