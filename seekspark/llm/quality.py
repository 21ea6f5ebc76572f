"""Operator 4: quality and toxicity classifier with naive Bayes support vectors.

A document is the set of its n-grams of one and two tokens and of the first PREFIX bytes of longer
tokens (indicators, hashed to 2**BITS places). Tokens are runs of letters, of digits or of other
signs in the lower-case text; a token that follows itself makes one common bigram whatever it is. For each label the indicators are scaled by the
log-count ratio of the two classes, log((p / |p|) / (q / |q|)) with SMOOTHING added to the counts,
and a linear hinge-loss model is fitted by dual coordinate descent. n-grams that fewer than MIN_DF
of the training documents have are left out.

Training takes at most MAX_ROWS labelled documents, those of least hash of doc_id and label: a bounded sample,
collected to the driver as n-gram numbers. The fitted weights are of fixed size, so scoring is
one pass over the documents without a shuffle.

Kept are documents with a quality score of at least 0 and a toxicity score below 0.

Defined results: a null text, or one without a token, has null scores and isn't kept. Labels that
are null or without a document don't train; of several labels of a doc_id the least counts, of
several texts each trains. Without two classes in the sample a label isn't fitted: its score is
+1 for quality, -1 for toxicity. Very long texts are scored whole. Repeated rows are scored alike; scores of exactly 0
count as above. Extra columns aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams as G
from .common import documents, lean, least_hashes, only, pieces, trim

#: Production parameters.
BITS, PREFIX, MAX_ROWS, MIN_DF, SMOOTHING, COST, EPOCHS, SEED = 20, 4, 12000, 5, 1.0, 0.01, 20, 1
_TEXT_CHARS = 2 << 20
_REPEAT = np.uint64(0x5851F42D4C957F2D)

_KIND = np.full(256, 3, np.uint8)  # 0: white space, 1: letter, 2: digit, 3: other sign
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(97, 123), *range(65, 91), *range(128, 256)]] = 1
_KIND[48:58] = 2


def features(texts: Sequence[str]) -> list[np.ndarray]:
    """The ascending places of each text's n-grams."""
    out = []
    for low, high in pieces([len(t) for t in texts], 1 << 20):
        data = [t.lower().encode() for t in texts[low:high]]
        b = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
        kind = _KIND[b]
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(b)]])
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        one = G.span_hashes(b, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data])).tolist()
        two = G.mix(one[:-1] * np.uint64(3) + one[1:]) if len(one) else one
        if len(two):
            two[one[:-1] == one[1:]] = _REPEAT
        one, two = (one >> np.uint64(64 - BITS)).astype(np.int32), (two >> np.uint64(64 - BITS)).astype(np.int32)
        longer = ends - starts > PREFIX
        heads = G.span_hashes(b, starts, np.where(longer, starts + PREFIX, ends)) ^ _REPEAT
        head = np.where(longer, (heads >> np.uint64(64 - BITS)).astype(np.int32), one)
        at = 0
        for e in bounds:
            out.append(np.unique(np.concatenate([one[at:e], head[at:e], two[at : e - 1]])) if e > at else np.empty(0, np.int32))
            at = e
    return out


def log_count_ratio(rows: Sequence[np.ndarray], y: np.ndarray, size: int, smoothing: float = SMOOTHING, min_df: int = MIN_DF) -> np.ndarray:
    """For each place the log of its share among the positive rows' n-grams over that among the negative ones'; y is +1 or -1."""
    count = lambda own: np.bincount(np.concatenate([r for r, o in zip(rows, own) if o] or [np.empty(0, np.int32)]), minlength=size).astype(float)
    p, q = count(y > 0), count(y < 0)
    often = p + q >= min_df
    p, q = p + smoothing, q + smoothing
    return np.where(often, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def dual_descent(rows: Sequence[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|**2 / 2 + sum of cost * hinge losses, rows being `values` at their places (Hsieh et al., 2008).

    The classes have equal total cost.
    """
    g = np.random.default_rng(seed)
    w, bias = np.zeros(len(values)), 0.0
    x = [values[r].astype(np.float32) for r in rows]
    square = np.array([v @ v for v in x]) + 1.0
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    alpha = np.zeros(len(y))
    for _ in range(epochs):
        largest = 0.0
        for i in g.permutation(len(y)).tolist():
            r, v = rows[i], x[i]
            slope = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                largest = max(largest, abs(step) * square[i])
                w[r] += step * v
                bias += step
                alpha[i] = new
        if largest < 1e-3:
            break
    return w, bias


class Model:
    """Weights (labels, 2**BITS) and biases of the labels, already scaled by the log-count ratios."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @classmethod
    def fitted(cls, rows: Sequence[np.ndarray], labels: Sequence[Sequence[int | None]], unfitted: Sequence[float] = (1.0, -1.0)) -> Model:
        """From rows and, for each label, its value (1, 0 or None) in each row."""
        size = 1 << BITS
        weights, bias = np.zeros((len(labels), size), np.float32), np.array(unfitted, float)
        for k, values in enumerate(labels):
            own = [i for i, v in enumerate(values) if v is not None and len(rows[i])]
            y = np.array([1.0 if values[i] else -1.0 for i in own])
            if len({*y.tolist()}) < 2:
                continue
            some = [rows[i] for i in own]
            ratio = log_count_ratio(some, y, size)
            w, bias[k] = dual_descent(some, ratio, y)
            weights[k] = w * ratio
        return cls(weights, bias)

    def scores(self, texts: Sequence[str]) -> list[list[float] | None]:
        return [(self.weights[:, r].sum(axis=1, dtype=float) + self.bias).tolist() if len(r) else None for r in features(texts)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from at most `max_rows` labelled documents."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    picked = least_hashes(one, max_rows).collect()
    table = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], "doc_id long, quality int, toxic int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "toxic")), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "toxic", "places"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(table, "doc_id").select("doc_id", "text", "quality", "toxic").mapInArrow(run, "doc_id long, quality int, toxic int, places binary").toPandas()
    found = found.sort_values(["doc_id", "places"], ignore_index=True)
    rows = [np.frombuffer(p, np.int32) for p in found["places"]]
    values = [[None if v != v or v is None else int(v) for v in found[c].tolist()] for c in ("quality", "toxic")]
    return Model.fitted(rows, values)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, source, n_chars, quality_score, toxicity_score) of each document."""
    lean(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(weights, bias)
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            found: list = []
            for low, high in pieces([len(t) for t in texts], _TEXT_CHARS):
                found += own.scores(texts[low:high])
            trim()
            yield pa.array([{"quality": None, "toxicity": None} if s is None else {"quality": s[0], "toxicity": s[1]} for s in found], pa.struct([("quality", pa.float64()), ("toxicity", pa.float64())]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(run, T.StructType([T.StructField("quality", T.DoubleType()), T.StructField("toxicity", T.DoubleType())])).asNondeterministic()
    docs = only(docs, ["doc_id", "text", "lang", "source", "n_chars"]).withColumn("score", score("text"))
    return docs.select("doc_id", "lang", "source", "n_chars", F.col("score.quality").alias("quality_score"), F.col("score.toxicity").alias("toxicity_score"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The scored documents that are kept."""
    return scored(docs, train(docs, labels, max_rows)).filter("quality_score >= 0 AND toxicity_score < 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_good(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
