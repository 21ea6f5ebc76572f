"""Embedding: identities, the deterministic offline encoder, and a planner that encodes each distinct text once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384


def fake_vector(text: str, dim: int = DIM) -> list[float]:
    """A unit vector from hashes of the text's ASCII words."""
    out = np.zeros(dim)
    for word in re.findall(r"\b\w+\b", text.lower(), re.ASCII) or ["__empty__"]:
        h = hashlib.sha256(word.encode()).digest()
        out[int.from_bytes(h[:8], "big") % dim] += 1.0
        out[int.from_bytes(h[8:16], "big") % dim] += 0.5 if h[16] & 1 else -0.5
    size = float(np.linalg.norm(out))
    return (out / size).tolist() if size else out.tolist()


def encoder(model: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, dim: int = DIM, batch: int = 32):
    """A column function text to array<float>, in batches; the deterministic encoder without a model. Checks counts and lengths."""
    run = model or (lambda texts: [fake_vector(t, dim) for t in texts])

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out: list = []
            texts = column.fillna("").tolist()
            for at in range(0, len(texts), batch):
                found = list(run(texts[at : at + batch]))
                if len(found) != len(texts[at : at + batch]) or any(len(v) != dim for v in found):
                    raise ValueError("the encoder returned vectors of another number or length")
                out += found
            yield pd.Series([np.asarray(v, np.float32) for v in out])

    return encode


def embedding_text(title: Column, indexed: Column, body: Column) -> Column:
    content = F.coalesce(F.nullif(indexed, F.lit("")), body)
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Title: "), title, F.lit("\n\n"), content)).otherwise(content)


def identity(namespace: str, text: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(namespace).alias("namespace"), text.alias("text"))), 256)


def revision(key: Column, text: Column, namespace: str, dim: int) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(dim).alias("dim"), F.lit(namespace).alias("model"), key.alias("storage_key"), text.alias("text"))), 256)


def namespace(model: str, version: str, normalization: str, instructions: str, dim: int) -> str:
    return hashlib.sha256(repr((model, version, normalization, instructions, dim)).encode()).hexdigest()


def plan(inputs: DataFrame, cache: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame]:
    """(identified inputs, misses): inputs (storage_key, text, priority, tier); a miss is a distinct text that the cache lacks."""
    own = inputs.withColumn("content_hash", identity(name, F.col("text")))
    distinct = own.groupBy("content_hash").agg(F.min("text").alias("text"), F.min("priority").alias("priority"), F.min(F.when(F.col("tier") == "coarse", 0).otherwise(1)).alias("fine"), F.count(F.lit(1)).alias("sources"))
    misses = distinct if cache is None else distinct.join(cache.filter(F.col("namespace") == name), "content_hash", "left_anti")
    return own, misses


def execute(own: DataFrame, misses: DataFrame, cache: DataFrame | None, name: str, encode) -> tuple[DataFrame, DataFrame]:
    """(storage_key, embedding) of all inputs, and the rows to add to the cache. Repeated cache rows of a text count once."""
    new = misses.select("content_hash", encode("text").alias("embedding"))
    known = new if cache is None else new.unionByName(cache.filter(F.col("namespace") == name).select("content_hash", "embedding").dropDuplicates(["content_hash"]))
    return own.select("storage_key", "content_hash").join(known, "content_hash").select("storage_key", "embedding"), new.withColumn("namespace", F.lit(name))


def prune(cache: DataFrame, live: DataFrame, name: str) -> DataFrame:
    """The cache without the namespace's rows that no live content_hash has."""
    keep = cache.filter(F.col("namespace") == name).join(live.select("content_hash"), "content_hash", "left_semi")
    return cache.filter(F.col("namespace") != name).unionByName(keep)
