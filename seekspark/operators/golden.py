"""Golden sets and evaluation reports: labelled queries as a table, compatibility checks on the driver."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "query string, relevant_ids array<string>, relevance map<string,double>, query_type string, query_class string, source_kinds array<string>, workspace_id string, tags array<string>, corpus_version string, split string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON golden set, with `gains`: graded relevance above 0 where given, else 1 for each relevant id."""
    entry = T._parse_datatype_string(SCHEMA)
    raw = spark.read.schema(T.StructType([T.StructField("entries", T.ArrayType(entry))])).json(path, multiLine=True)
    e = raw.select(F.inline("entries"))
    plain = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("relevant_ids", F.array().cast("array<string>"))), lambda i: F.struct(i, F.lit(1.0))))
    return e.withColumn("gains", F.when(F.col("relevance").isNotNull(), F.map_filter("relevance", lambda _, g: g > 0)).otherwise(plain))


def save(golden: DataFrame, path: str) -> None:
    columns = [c.split()[0] for c in SCHEMA.replace("map<string,double>", "map").split(", ")]
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in golden.select(*columns).collect()]
    with open(path, "w") as f:
        json.dump({"entries": rows}, f, ensure_ascii=False)


def gains(golden: DataFrame) -> DataFrame:
    """(query_id, item, gain): a query's text is its id."""
    return golden.select(F.col("query").alias("query_id"), F.explode("gains").alias("item", "gain"))


def compatible(report: Mapping, baseline: Mapping, keys: tuple[str, ...] = ("corpus_version", "k", "queries")) -> list[str]:
    """Why two reports can't be compared."""
    return [f"{k}: {report.get(k)!r} against {baseline.get(k)!r}" for k in keys if report.get(k) != baseline.get(k)]


def regressions(report: Mapping, baseline: Mapping, tolerance: Mapping[str, float]) -> list[str]:
    if problems := compatible(report, baseline):
        raise ValueError("; ".join(problems))
    return [f"{m}: {report['metrics'][m]} after {v}" for m, v in baseline["metrics"].items() if report["metrics"][m] < v - tolerance.get(m, 0.0)]


class Trace:
    """Wall-clock spans on the driver."""

    def __init__(self) -> None:
        self.spans: dict[str, float] = {}

    @contextmanager
    def span(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans[name] = self.spans.get(name, 0.0) + time.perf_counter() - began
