"""Operator 7: Jaccard join of documents on word n-grams, by MinHash banding.

1. Each text becomes the set of its hashed word n-grams. Texts with the same set are one class;
   from there on work is per class, so a thousand exact copies cost as much as one.
2. Each class gets `bands` keys of `rows` MinHash values each, chosen so that a pair at the
   threshold meets in a band with probability `recall`. The keys are made of the stored byte of each value
   (32 bits with 4 values: n classes give each about n / 2**32 chance partners a band, which step 2 or 3 dismisses).
   One shuffle on the keys brings the members of each bucket together, and classes that meet in several bands
   with no others are one bucket; a bucket of more than PART members is dealt to parts, and each pair
   of parts is a task of its own. In a bucket, pairs whose MinHash values agree less often than
   three standard deviations below the threshold are dismissed, which keeps chance meetings from
   chaining the corpus together; the others are linked by a spanning forest, so links stay
   linear in the number of classes however large a group of copies is.
3. The components of the links are dealt to blocks of bounded weight. Pairs within a block are verified, and
   those of two blocks of a component if any of their members met in a band, all on the full
   n-gram sets (blocked 0/1 matrix products). No bucket, partner list or component is capped: a
   large one is only more parts and blocks.

The registered query (`near_classes`) has one row for each document: the smallest doc_id of the documents
that links connect (class_id) and of those with the same n-grams (copy_of), how many others have the same
(n_copies), and how many different n-gram sets are linked to its own (n_links). Links are counted, and connected
to stars, in the tasks that verify them, so what is written grows with the documents although links
are quadratic in a group of near copies. `similar_pairs` gives the links themselves: a row for each
verified pair of classes, named by the smallest doc_id of each (class_a <> class_b), and a row of similarity 1.0 from
that doc_id to each further member of a class (class_a = class_b). No link between different texts is
lost, and joining the pairs with the members on both sides gives the pairs of all documents
(`document_pairs`).

Defined results: a null or empty text (or one of white space only) has no n-grams and no partners;
a text of fewer than n words has one n-gram, of all its words; the sets are those of whole texts,
however long; rows with a null doc_id cannot be named, have no partners and no row; rows that
repeat a doc_id and text are one document; a doc_id with several texts is a member of the class of
each, with a row for each, and may name both classes of a pair; pairs at the threshold, and equal ones, all count.
Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import grams as G
from .common import documents, drop_path, lean, only, pieces, spare_name, trim

#: Production parameters.
N, THRESHOLD, RECALL = 3, 0.6, 0.99
#: n-grams of a block, what a class (a node) adds to the weight besides its own, and members of a bucket's part.
BLOCK_GRAMS, NODE_WEIGHT, PART = 1 << 20, 512, 4096
#: Up to these bytes of linked doc_ids are broadcast to the scan of the texts.
BROADCAST_BYTES = 64 << 20
_TEXT_BYTES = 4 << 20
_CELLS = 1 << 22
#: MinHash values at most.
_HASHES = 160
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`common.written`; the shuffle files that it took go at its end, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return common.written(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _binary(a: np.ndarray, width: int) -> pa.Array:
    """Rows of `width` bytes as an Arrow binary column."""
    n = a.nbytes // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that name each n-gram set (two independent sums of its mixed hashes)."""
    joined = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2), np.uint64)
    for k, salt in enumerate((0x1234567, 0x89ABCDEF1)):
        out[:, k] = G.mix(np.add.reduceat(G.mix(joined ^ np.uint64(salt)), at) + np.uint64(salt))
    return out


def _batches(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Parts of the batch with their texts and n-gram sets, without the rows that have none."""
    column = [t or "" for t in batch.column("text").to_pylist()]
    for low, high in pieces([len(t) for t in column], _TEXT_BYTES):
        part, texts = batch.slice(low, high - low), column[low:high]
        sets = G.gram_sets(texts, n)
        kept = [i for i, s in enumerate(sets) if len(s)]
        if kept:
            yield part.take(pa.array(kept)), [texts[i] for i in kept], [sets[i] for i in kept]
    del column
    trim()


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, th, node, grams, prints) for each document with a doc_id and an n-gram; th is a hash of the text."""
    bands, rows = G.bands_and_rows(threshold, recall, _HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, sets in _batches(batch, n):
                prints = _binary(G.prints(sets, bands * rows), bands * rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), _binary(_nodes(sets), 16), pa.array([len(s) for s in sets], pa.int64()), prints], ["doc_id", "th", "node", "grams", "prints"])

    own = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, "doc_id long, th long, node binary, grams long, prints binary")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes of the undirected `edges` (a, b): root is the smallest id of the component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) on written tables; the number
    of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y"), "b")
        small = small.select("x", F.explode(F.array_distinct(F.array("y", "b"))).alias("y")).filter("x <> y")
        after = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        drop_path(spark, now.written_at)
        now = after
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def _pairs(sets: list[np.ndarray], first: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified pairs (i, j, similarity) of sets: i before j; if `first`, only those with i < first <= j."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], float)
        rows = slice(0, 1)
    else:
        _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes)
        shared = df[ids] > 1  # an n-gram of one set only adds to no intersection
        ids, owner = ids[shared], owner[shared]
        ids = np.unique(ids, return_inverse=True)[1]
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        rows = slice(0, first or m)
        common = np.zeros((first or m, m), np.float64)
        width = max(64, _CELLS // m)
        for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
            s, e = np.searchsorted(ids, [low, low + width])
            x = np.zeros((m, width), np.float32)
            x[owner[s:e], ids[s:e] - low] = 1
            common += x[rows] @ x.T
    i, j = np.nonzero(common)
    ok = (j >= first) if first else (i < j)
    i, j = i[ok], j[ok]
    both = common[i, j]
    similarity = both / (sizes[i] + sizes[j] - both)
    ok = similarity >= threshold
    return i[ok], j[ok], similarity[ok]


def _forest(prints: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the rows, where rows that agree in at least `least` places are linked."""
    rest = np.arange(1, len(prints))
    queue = [0]
    while queue or len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        at = queue.pop()
        if len(rest):
            near = (prints[rest] == prints[at]).sum(axis=1) >= least
            found, rest = rest[near].tolist(), rest[~near]
            queue += found
            yield from ((at, x) for x in found)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first `keys` columns, as (key, the other columns of each row)."""
    key, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if own:
                    yield key, own
                key, own = row[:keys], []
            own.append(row[keys:])
    if own:
        yield key, own


def _least(threshold: float, recall: float) -> tuple[int, int]:
    """MinHash values of a class, and how many must agree."""
    bands, rows = G.bands_and_rows(threshold, recall, _HASHES)
    k = bands * rows
    return k, int(np.ceil(k * threshold - 3 * np.sqrt(k * threshold * (1 - threshold))))


def _buckets(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(bucket, id, parts): the members of each bucket of two or more; the same members are one bucket, however many bands they meet in.

    A bucket is named by its members' hashes; if two had the same name, they would be one, and no pair would be lost.
    """
    bands, rows = G.bands_and_rows(threshold, recall, _HASHES)
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("prints", 1 + k * rows, rows)) for k in range(bands)])
    own = Window.partitionBy("band")
    met = nodes.select("id", F.explode(keys).alias("band"))
    met = met.select("id", F.count(F.lit(1)).over(own).alias("c"), F.bit_xor(F.xxhash64("id")).over(own).alias("bucket"))
    return met.filter("c > 1").select("bucket", "id", F.ceil(F.col("c") / PART).cast("int").alias("parts")).distinct()


def _met(buckets: DataFrame, nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(bucket, i, j, part, id, prints, *extra): the members of each bucket by pairs (i, j) of its parts, sorted within their task."""
    met = buckets.join(nodes.select("id", "prints", *extra), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "prints", *extra)
    return met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")


def links(buckets: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b): ids of a bucket whose MinHash values agree about as often as `threshold`, or not linked but by others."""
    k, least = _least(threshold, recall)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, own in _groups(batches, 3):
            prints = np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(len(own), k)
            for i, j in _forest(prints, least):
                a.append(own[i][1])
                b.append(own[j][1])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _met(buckets, nodes, []).mapInArrow(link, "a long, b long")


def _block_pairs(buckets: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(root, i, j), i < j: blocks of a component with members that met in a band and agree."""
    k, least = _least(threshold, recall)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for _, own in _groups(batches, 3):
            prints = np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(len(own), k)
            block = np.array([r[4] for r in own])
            for x in range(len(own) - 1):
                near = (prints[x + 1 :] == prints[x]).sum(axis=1) >= least
                for other in np.unique(block[x + 1 :][near]).tolist():
                    if other != own[x][4]:
                        seen.add((own[x][3], min(other, own[x][4]), max(other, own[x][4])))
            if len(seen) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen), (pa.int64(), pa.int32(), pa.int32()))], ["root", "i", "j"])
                seen = set()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen), (pa.int64(), pa.int32(), pa.int32()))], ["root", "i", "j"])

    return _met(buckets, nodes, ["root", "block"]).mapInArrow(pair, "root long, i int, j int").distinct()


def _connected(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m places the least one that the pairs (i, j) connect it with."""
    label = np.arange(m)
    while True:
        before, low = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def node_pairs(docs: DataFrame, signed: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, summary: bool = False) -> DataFrame:
    """Verified pairs (node_a, node_b, doc_a, doc_b, similarity) of different nodes, with the smallest doc_id of each; `signed` are the written signatures.

    As a `summary`: (node, links, other), the number of links that a task found for a node and another node that they connect it with.
    """
    spark = docs.sparkSession
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("grams").alias("grams"), F.first("prints").alias("prints"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    buckets = written(_buckets(nodes, threshold, recall), "buckets")
    found = components(links(buckets, nodes, threshold, recall))
    sized = found.join(nodes.select("id", "node", "doc_id", "grams"), "id").withColumn("weight", F.col("grams") + NODE_WEIGHT)
    of = sized.groupBy("root").agg(F.ceil(F.sum("weight") / BLOCK_GRAMS).cast("int").alias("of"))
    blocks = written(sized.join(of, "root").select("id", "node", "doc_id", "root", F.pmod(F.xxhash64("node"), F.col("of")).cast("int").alias("block"), "of"), "blocks")
    large = blocks.filter("of > 1")
    tasks = None
    if of_large := large.count():
        some = large.select("id", "root", "block")
        pairs = written(_block_pairs(buckets, nodes.join(F.broadcast(some) if of_large * 32 <= BROADCAST_BYTES else some, "id"), threshold, recall), "block-pairs")
        tasks = large.select("root", "block", F.col("block").alias("i"), F.col("block").alias("j")).distinct()
        tasks = written(tasks.union(pairs.select("root", F.col("i").alias("block"), "i", "j")).union(pairs.select("root", F.col("j").alias("block"), "i", "j")), "tasks")
        drop_path(spark, pairs.written_at)
    for table in (nodes, buckets):
        drop_path(spark, table.written_at)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the rows whose text is the node's: a doc_id may have several texts."""
        for batch in batches:
            for part, _, sets in _batches(batch, n):
                yield part.filter(pa.array([x == y for x, y in zip(part.column("node").to_pylist(), _binary(_nodes(sets), 16).to_pylist())]))

    def placed(blocks: DataFrame) -> DataFrame:
        """(root, block, node, doc_id, text) of the nodes of `blocks`."""
        texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
        if blocks.count() * 16 <= BROADCAST_BYTES:  # else all texts are shuffled to meet the linked ones
            texts = texts.join(F.broadcast(blocks.select("doc_id").distinct()), "doc_id", "left_semi")
        return texts.join(blocks, "doc_id").select("root", "block", "node", "doc_id", "text").mapInArrow(right, "root long, block int, node binary, doc_id long, text string")

    at = ["root", "i", "j", "block", "node", "doc_id", "text"]  # a component of one block is one task, and its texts aren't shuffled to find it
    work = placed(blocks.filter("of = 1")).withColumns({"i": F.col("block"), "j": F.col("block")}).select(*at)
    if tasks is not None:
        work = work.union(placed(large).join(F.broadcast(tasks) if tasks.count() * 32 <= BROADCAST_BYTES else tasks, ["root", "block"]).select(*at))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), own in _groups(batches, 3):
            own = [x for x, before in zip(own, [None, *own]) if before is None or x[1] != before[1]]  # repeated rows
            sets = [s for low, high in pieces([len(x[3]) for x in own], _TEXT_BYTES) for s in G.gram_sets([x[3] for x in own[low:high]], n)]
            first = sum(x[0] == i for x in own) if i != j else 0
            if len(own) > 1 and first < len(own):
                a, b, similarity = _pairs(sets, first, threshold)
                if summary:
                    nodes, label = pa.array([x[1] for x in own], pa.binary()), _connected(len(own), a, b)
                    links = np.bincount(np.concatenate([a, b]), minlength=len(own))
                    some = pa.array(np.flatnonzero(links))
                    yield pa.RecordBatch.from_arrays([nodes.take(some), pa.array(links).take(some), nodes.take(pa.array(label)).take(some)], ["node", "links", "other"])
                    continue
                names, nodes = np.array([x[2] for x in own], np.int64), pa.array([x[1] for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b)), pa.array(names[a]), pa.array(names[b]), pa.array(similarity)], ["node_a", "node_b", "doc_a", "doc_b", "similarity"])
        trim()

    work = work.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "node")
    return work.mapInArrow(verify, "node binary, links long, other binary" if summary else "node_a binary, node_b binary, doc_a long, doc_b long, similarity double")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_a, doc_b, similarity, class_a, class_b): the pairs of classes (doc_a <= doc_b) and their members, as the module's text says; a class is 32 hexadecimal digits."""
    lean(docs.sparkSession)
    docs = only(docs, ["doc_id", "text"])
    signed = written(signatures(docs, n, threshold, recall), "signatures")
    turned = F.col("doc_a") > F.col("doc_b")
    pairs = node_pairs(docs, signed, n, threshold, recall).select(
        F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "similarity",
        F.hex(F.when(turned, F.col("node_b")).otherwise(F.col("node_a"))).alias("class_a"), F.hex(F.when(turned, F.col("node_a")).otherwise(F.col("node_b"))).alias("class_b"),
    )
    names = signed.groupBy("node").agg(F.min("doc_id").alias("doc_a"))
    members = signed.select("node", "doc_id").distinct().join(names, "node").filter("doc_id <> doc_a")
    return pairs.union(members.select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("similarity"), F.hex("node").alias("class_a"), F.hex("node").alias("class_b")))


def document_pairs(found: DataFrame) -> DataFrame:
    """(doc_a, doc_b, similarity), doc_a < doc_b, for all pairs of documents, from the rows of `similar_pairs`: quadratic in a group's size."""
    own = found.select("class_a", "doc_a").union(found.select("class_b", "doc_b")).distinct()
    left, right = own.toDF("class_a", "x"), own.toDF("class_b", "y")
    near = found.filter("class_a <> class_b").select("class_a", "class_b", "similarity").join(left, "class_a").join(right, "class_b").filter("x <> y")
    exact = left.join(own.toDF("class_a", "y"), "class_a").filter("x < y").select("x", "y", F.lit(1.0))
    return near.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "similarity").union(exact)


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`docs` without the documents whose text is similar, directly or by way of others, to that of another one that stays.

    Of each group the smallest doc_id stays (of several texts of it in the group one). A row goes only for its own
    text: a doc_id with several texts may lose one and keep another. Rows with a null doc_id stay, and
    rows that repeat a doc_id and text are one document.
    """
    lean(docs.sparkSession)
    own = only(docs, ["doc_id", "text"])
    signed = written(signatures(own, n, threshold, recall), "signatures")
    found = node_pairs(own, signed, n, threshold, recall, summary=True)
    found = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).toDF("node", "root")
    texts = signed.select("doc_id", "th", "node").distinct().join(found, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    first = texts.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    extra = texts.join(first, "root").filter("doc_id <> first.doc_id OR th <> first.th").select("doc_id", F.col("th").alias(th := spare_name(docs, "th")))
    extra = written(extra, "extra")
    return docs.withColumn(th, F.xxhash64("text")).join(extra, ["doc_id", th], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links) of each document, as the module's text says; without an n-gram it is a class of its own."""
    lean(docs.sparkSession)
    docs = only(docs, ["doc_id", "text"])
    signed = written(signatures(docs, n, threshold, recall), "signatures")
    found = written(node_pairs(docs, signed, n, threshold, recall, summary=True), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).toDF("node", "root")
    members = signed.select("doc_id", "node").distinct()
    sets = members.groupBy("node").agg(F.min("doc_id").alias("copy_of"), (F.count(F.lit(1)) - 1).alias("n_copies"))
    sets = sets.join(found.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left").join(roots, "node", "left")
    sets = written(sets.withColumn("root", F.coalesce("root", "node")), "sets")
    sets = sets.join(sets.groupBy("root").agg(F.min("copy_of").alias("class_id")), "root")
    out = members.join(sets, "node").select("doc_id", "class_id", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    bare = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(signed.select("doc_id"), "doc_id", "left_anti")
    return out.union(bare.select("doc_id", "doc_id", "doc_id", F.lit(0), F.lit(0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
