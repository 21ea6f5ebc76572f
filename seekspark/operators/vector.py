"""Vector lane: exact cosine top-k for many queries at once, stored-vector codec, approximate search.

Up to BLOCK_ROWS queries go to all tasks as one block of checked size; each task multiplies it with the Arrow
batches of its own vectors and keeps the k best, so the vectors are neither shuffled nor converted row
by row, and only k rows for each query and task meet. More queries than that are done in blocks:
queries and vectors are dealt to a square grid of tasks, of which each keeps the k best of its queries, and a last aggregation
merges them. The side of the grid follows from the number of tasks, and is more only where a task would hold over TASK_ROWS of either,
so copies of the input grow with the tasks and not with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK_ROWS = 4096
#: Rows of either side that one task of the grid holds at most, scores that pay a task, and tasks that are enough where cores are fewer.
TASK_ROWS, TASK_SCORES, TASKS = 65_536, 100_000_000, 256


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def encoded(v: Column, dim: int) -> Column:
    """The stored form: unit length, floats; raises for a wrong length, a zero or a value that isn't finite."""
    n = norm(v)
    valid = (F.size(v) == dim) & (n > 0) & ~F.isnan(n) & (n != float("inf"))
    return F.when(F.assert_true(valid, F.lit("not a usable vector")).isNull(), F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def _dealt(df: DataFrame, key: str, side: int, *more: str) -> DataFrame:
    return df.select(F.pmod(F.xxhash64(key), F.lit(side)).cast("int").alias("b"), F.col(key).alias("k"), F.col("embedding").alias("v"), *more, F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("o"))


def _grid(vectors: DataFrame, queries: DataFrame, k: int, key: str, skip_self: bool, digits: int, *more: str) -> DataFrame:
    """(query_id, key, score): the k best of each query in each task of the grid. `more` may name a column of bucket numbers (array<int>) of both
    sides; then only pairs that have one in common, at the same place, count."""
    n, m = vectors.count(), queries.count()
    tasks = max(1, min(max(TASKS, 2 * vectors.sparkSession.sparkContext.defaultParallelism), -(-n * m // TASK_SCORES)))
    side = max(1, math.isqrt(tasks - 1) + 1, -(-max(n, m) // TASK_ROWS))
    left, right = _dealt(queries, "query_id", side, *more), _dealt(vectors, key, side, *more)
    kinds = [left.schema["k"].dataType, right.schema["k"].dataType]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())])

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        keys = np.array(b["k"].to_pylist(), object)
        b = b.take(pa.array(np.argsort(keys, kind="stable")))
        names = [a["k"].to_pylist(), b["k"].to_pylist()]
        place: dict = {}
        codes = np.array([place.setdefault(x, len(place)) for x in names[1]], int)  # repeated keys have one
        same = np.array([place.get(x, -1) if skip_self else -1 for x in names[0]], int)
        buckets = [np.array(t[more[0]].to_pylist(), np.int32).reshape(len(t), -1) for t in (a, b)] if more else None
        q, d, s = _k_best(a["v"], b["v"], k, digits, same, codes, buckets)
        return pa.table([a["k"].take(pa.array(q)), b["k"].take(pa.array(d)), pa.array(s, pa.float64())], names=schema.names)

    # as many partitions as four for a task, by number, so that they aren't merged for being small
    a = left.withColumnsRenamed({"b": "i", "o": "j"}).repartition(4 * side * side, "i", "j").groupBy("i", "j")
    b = right.withColumnsRenamed({"o": "i", "b": "j"}).repartition(4 * side * side, "i", "j").groupBy("i", "j")
    return a.cogroup(b).applyInArrow(score, schema)


def _rows(vectors: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The lengths, and by length the unit vectors of those rows."""
    flat, sizes = vectors.combine_chunks(), pc.list_value_length(vectors).to_numpy()
    values, ends = pc.list_flatten(flat).to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        x = values[(ends - sizes)[sizes == n][:, None] + np.arange(n)]
        out[int(n)] = x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, 1)
    return sizes, out


def _k_best(left: pa.ChunkedArray, right: pa.ChunkedArray, k: int, digits: int, same: np.ndarray, codes: np.ndarray, buckets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, score): the k best by rounded score, then row of right; of `codes` not a row's own one, `same`.

    Single precision finds what may be among the best; those few are scored in double precision.
    """
    out: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if not len(left) or not len(right):
        return out[0]
    (sizes, xs), (widths, ys) = _rows(left), _rows(right)
    beyond = k + int(np.bincount(codes).max())  # as many as may be a row's own
    for n, x in xs.items():
        own, y = np.flatnonzero(sizes == n), np.zeros((len(widths), n))
        if n in ys:
            y[widths == n] = ys[n]  # the cosine with a vector of another length is 0
        low, thin = 4 * n * np.finfo(np.float32).eps + 10.0**-digits, y.astype(np.float32)
        for top in range(0, len(own), 1024):
            rows = own[top : top + 1024]
            z = x[top : top + 1024]
            fine = z.astype(np.float32)
            q, d, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            least = np.full(len(rows), -np.inf)
            for at in range(0, len(y), BLOCK_ROWS):
                near = fine @ thin[at : at + BLOCK_ROWS].T
                if np.isinf(least).any():  # the first block: most pairs would pass
                    mine = rows[:, None] >= 0
                    if buckets:
                        mine = np.zeros(near.shape, bool)
                        for u, v in zip(buckets[0][rows].T, buckets[1][at : at + BLOCK_ROWS].T):
                            mine |= u[:, None] == v
                    bound = least
                    if near.shape[1] > beyond:
                        bound = np.maximum(least, np.partition(np.where(mine, near, -np.inf), -beyond, 1)[:, -beyond])
                    new_q, new_d = np.nonzero(mine & (near >= (bound - low)[:, None]))
                else:
                    new_q, new_d = np.nonzero(near >= (least - low)[:, None])
                new_d += at
                fit = codes[new_d] != same[rows][new_q]
                if buckets:
                    fit &= (buckets[0][rows[new_q]] == buckets[1][new_d]).any(1)
                new_q, new_d = new_q[fit], new_d[fit]
                q, d = np.append(q, new_q), np.append(d, new_d)
                s = np.append(s, np.round(np.einsum("ij,ij->i", z[new_q], y[new_d]), digits))
                order = np.lexsort((d, -s, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                order, place = order[place < k], place[place < k]
                q, d, s = q[order], d[order], s[order]
                least = np.full(len(rows), -np.inf)
                least[q[place == k - 1]] = s[place == k - 1]
            out.append((rows[q], d, s))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "storage_key", skip_self: bool = False, digits: int = 9) -> DataFrame:
    """(query_id, key, score, rank): the k vectors of highest cosine for every query (query_id, embedding); ties by key.

    Null vectors have no score; one of another length than the query's has 0.
    """
    vectors, queries = vectors.filter("embedding IS NOT NULL").select(key, "embedding"), queries.filter("embedding IS NOT NULL").select("query_id", "embedding")
    few = queries.limit(BLOCK_ROWS + 1).select("query_id", F.col("embedding").cast("array<double>").alias("v")).toPandas()
    if len(few) <= BLOCK_ROWS and len({len(v) for v in few["v"]}) <= 1:
        return _best(_by_query_block(vectors, few, queries.schema["query_id"].dataType.simpleString(), k, key, skip_self, digits), k, key)
    return _best(_grid(vectors, queries, k, key, skip_self, digits), k, key)


def _matrix(vectors: Iterable, width: int) -> np.ndarray:
    """Rows of `width`; a vector of another length is zero, so that its cosine is 0."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if len(v) == width:
            out[i] = v
    return out


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _by_query_block(vectors: DataFrame, queries: pd.DataFrame, query_type: str, k: int, key: str, skip_self: bool, digits: int) -> DataFrame:
    """(query_id, key, score): the k best of each query in each task."""
    ids = queries["query_id"].to_numpy()
    x = np.array(queries["v"].tolist(), float).reshape(len(ids), -1)
    x /= np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, 1)
    own = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names = np.empty((len(ids), 0)), np.empty((len(ids), 0), object)
        for batch in batches if len(ids) else ():
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                keys, column = np.array(part.column(0).to_pylist(), object), part.column(1)
                if bool((np.diff(column.offsets.to_numpy()) == x.shape[1]).all()):
                    y = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
                else:
                    y = _matrix(column.to_pylist(), x.shape[1])
                y /= np.where((s := np.linalg.norm(y, axis=1, keepdims=True)) > 0, s, 1)
                score = np.round(x @ y.T, digits)
                if skip_self:
                    score[ids[:, None] == keys[None]] = -np.inf
                by_key = np.argsort(keys, kind="stable")
                at = np.argsort(-score[:, by_key], axis=1, kind="stable")[:, :k]
                best, names = np.concatenate([best, np.take_along_axis(score[:, by_key], at, 1)], 1), np.concatenate([names, keys[by_key][at]], 1)
                order = np.unique(names, return_inverse=True)[1].reshape(names.shape)
                at = np.lexsort((order, -best))[:, :k]
                best, names = np.take_along_axis(best, at, 1), np.take_along_axis(names, at, 1)
        real = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1)).tolist(), types[0]), pa.array(names[real].tolist(), types[1]), pa.array(best[real], pa.float64())], ["query_id", key, "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = T._parse_datatype_string(f"query_id {query_type}, {key} {own}, score double")
    types = [to_arrow_type(f.dataType) for f in schema.fields[:2]]
    return vectors.mapInArrow(run, schema)


def top_k_single(vectors: DataFrame, query: list[float], k: int, key: str = "storage_key") -> DataFrame:
    """For one query vector: a projection and TakeOrderedAndProject, no shuffle but the k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def stats(vectors: DataFrame, *groups: str) -> DataFrame:
    return vectors.groupBy(*groups, F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size("embedding") * F.lit(4)).cast("long").alias("bytes"))


def approximate(vectors: DataFrame, queries: DataFrame, k: int, key: str = "storage_key", tables: int = 12, width: float = 1.0, skip_self: bool = False) -> DataFrame:
    """Top-k of the pairs that share a random-projection bucket in one of the tables, scored exactly; check it with `recall`.

    Pairs that share a bucket may be nearly all, so they are never rows: the grid of `top_k` scores them in blocks and drops those that share none.
    """
    lsh = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=width, numHashTables=tables, seed=7)
    unit = lambda df, name: df.filter("embedding IS NOT NULL").select(name, "embedding", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("f", array_to_vector(F.transform("v", lambda x: x / norm(F.col("v")))))
    a, b = unit(queries, "query_id"), unit(vectors, key)
    model = lsh.fit(b)
    bucket = lambda df, name: model.transform(df).select(name, "embedding", F.transform("h", lambda x: F.get(vector_to_array(x), 0).cast("int")).alias("w"))
    return _best(_grid(bucket(b, key), bucket(a, "query_id"), k, key, skip_self, 9, "w"), k, key)


def recall(found: DataFrame, exact: DataFrame, key: str = "storage_key") -> DataFrame:
    """(query_id, recall): the share of the exact neighbours that was found."""
    hit = found.select("query_id", key, F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", key], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))

