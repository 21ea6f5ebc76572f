"""Operator 9: cost-balanced packing of documents into training sequences.

A document of n tokens costs LINEAR * n + QUADRATIC * n * n, the work of the feed-forward and the
attention layers. Documents are dealt to pools by hash, each of about `pool_tokens` tokens; in a
pool the number of sequences is what its tokens need at `fill`, and documents in descending length
go to the sequence of lowest cost that has the tokens left, a new one being opened where none has.
Pools are independent tasks, so packing needs one shuffle of (document, length) rows, no texts. Rows that
repeat a document are counted first and dealt to pools one by one, so that no pool gets them all.

A document longer than a sequence is first cut into pieces of `capacity` tokens and a rest; pieces
are packed like documents. Tokens are runs of characters that aren't white space, or any column of
counts that is given.

Defined results: a document without tokens (null or empty text) gets no row; a null doc_id is
packed like others; repeated rows are packed as often as they occur; very long texts are cut as said. Documents of equal length go
by doc_id (null first), then hash of the text, then number of the repeated row. Extra columns aren't read. An empty table gives an
empty result. The same rows give the same packing in any partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, written

#: Production parameters: tokens of a sequence and of a pool, the share of a pool's sequences to fill, cost by token and token squared.
CAPACITY, POOL_TOKENS, FILL = 4096, 1 << 21, 0.98
LINEAR, QUADRATIC = 1.0, 1.0 / 8192


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def pack(lengths: np.ndarray, capacity: int, fill: float = FILL, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each piece; lengths must descend and be at most `capacity`."""
    n = max(1, int(np.ceil(lengths.sum() / (capacity * fill)))) if len(lengths) else 0
    cost, left = np.zeros(max(n, len(lengths))), np.zeros(max(n, len(lengths)), np.int64)
    left[:n] = capacity
    out = np.empty(len(lengths), np.int64)
    for i, k in enumerate(lengths.tolist()):
        open_cost = np.where(left[:n] >= k, cost[:n], np.inf)
        at = int(open_cost.argmin())
        if open_cost[at] == np.inf:
            at, left[n] = n, capacity
            n += 1
        out[i] = at
        left[at] -= k
        cost[at] += linear * k + quadratic * k * k
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS, fill: float = FILL, tokens: Column | None = None) -> DataFrame:
    """(pool, sequence, slot, doc_id, piece, n_tokens, cost): slot is the place of the piece's first token in the sequence."""
    docs = docs if tokens is not None else only(docs, ["doc_id", "text"])
    counted = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), (word_count(F.col("text")) if tokens is None else tokens).alias("n")).filter("n > 0")
    counted = written(counted, "lengths")  # texts are read once
    total = counted.agg(F.sum("n")).first()[0] or 0
    pools = max(1, -(-total // pool_tokens))
    copies = counted.groupBy("doc_id", "h", "n").agg(F.count(F.lit(1)).alias("c")).select("doc_id", "h", "n", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("copy"))
    dealt = copies.select(F.pmod(F.when(F.col("copy") == 1, F.col("h")).otherwise(F.xxhash64("h", "copy")), F.lit(pools)).alias("pool"), "doc_id", "h", "copy", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    dealt = dealt.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long"))

    def place(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["n_tokens", "doc_id", "h", "copy", "piece"], ascending=[False, True, True, True, True], na_position="first", kind="stable")
        pool["sequence"] = pack(pool["n_tokens"].to_numpy(), capacity, fill)
        pool["slot"] = pool.groupby("sequence")["n_tokens"].cumsum() - pool["n_tokens"]
        pool["cost"] = LINEAR * pool["n_tokens"] + QUADRATIC * pool["n_tokens"] ** 2
        pool["doc_id"] = pool["doc_id"].astype("Int64")
        return pool[["pool", "sequence", "slot", "doc_id", "piece", "n_tokens", "cost"]]

    return dealt.drop("n").groupBy("pool").applyInPandas(place, "pool long, sequence long, slot long, doc_id long, piece int, n_tokens long, cost double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
