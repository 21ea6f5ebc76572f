"""Ingestion as Structured Streaming: idempotent upserts by micro-batch, a cursor that never passes a failure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyword
from ..sources.store import Checkpoints, Tables, latest


@dataclass(frozen=True)
class Receipt:
    batch_id: int
    rows: int
    rejected: int
    cursor: str | None
    changed: bool


def valid(batch: DataFrame) -> DataFrame:
    """Adds `error`: why a row can't be ingested, or null."""
    return batch.withColumn("error", F.when(F.col("storage_key").isNull(), "no key").when(F.coalesce("title", F.lit("")) == "", F.when(F.coalesce("body", F.lit("")) == "", "no text")))


def safe_cursor(batch: DataFrame, cursor: str) -> str | None:
    """The greatest cursor before the first rejected row; that of the last row if none is."""
    first_bad = batch.agg(F.min(F.when(F.col("error").isNotNull(), F.col(cursor))).alias("c")).first()["c"]
    good = batch if first_bad is None else batch.filter(F.col(cursor) < F.lit(first_bad))
    last = good.agg(F.max(cursor).alias("c")).first()["c"]
    return None if last is None else str(last)


class Ingestor:
    """Writes micro-batches to the tables records and, where their text changed, postings and lengths: all of a batch in one change.

    The cursor that is stored never falls and never passes a rejected row, of whatever batch: after the first
    one it is held before it until `release`.
    """

    def __init__(self, tables: Tables, checkpoints: Checkpoints, kind: str, cursor: str = "updated_at", workspace: str | None = None, strict: bool = True):
        self.tables, self.checkpoints, self.kind, self.cursor, self.workspace, self.strict = tables, checkpoints, kind, cursor, workspace, strict
        self.receipts: list[Receipt] = []
        self.held: object = None

    def release(self) -> None:
        """Rejected rows were dealt with: the cursor may go on."""
        self.held = None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        marked = valid(batch)
        rejected = marked.filter("error IS NOT NULL").count()
        if rejected and self.strict:
            raise ValueError(f"{rejected} rows of batch {batch_id} can't be ingested")
        good = latest(marked.filter("error IS NULL").drop("error"), self.cursor)
        old = self.tables.read("records") if self.tables.exists("records") else None
        changed = old is None or not good.select(old.columns).exceptAll(old).isEmpty()
        if changed:
            index, keys = keyword.build(good), good.select("storage_key")
            new = {"records": good, "postings": index.postings, "lengths": index.documents}
            if old is not None:
                new = {name: self.tables.read(name).join(keys, "storage_key", "left_anti").unionByName(rows, allowMissingColumns=True) for name, rows in new.items()}
            self.tables.replace(**new)
        first_bad = marked.agg(F.min(F.when(F.col("error").isNotNull(), F.col(self.cursor))).alias("c")).first()["c"]
        if first_bad is not None and (self.held is None or first_bad < self.held):
            self.held = first_bad
        before = marked if self.held is None else marked.filter(F.col(self.cursor) < F.lit(self.held))
        cursor = safe_cursor(before, self.cursor)
        if cursor is not None:
            stored = self.checkpoints.get(self.workspace, self.kind)
            kind = marked.schema[self.cursor].dataType
            ahead = stored is None or marked.sparkSession.range(1).select(F.lit(cursor).cast(kind) > F.lit(stored).cast(kind)).first()[0]
            if ahead:
                self.checkpoints.set(self.workspace, self.kind, cursor)
        self.receipts.append(Receipt(batch_id, batch.count(), rejected, cursor, changed))

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def since(source: DataFrame, cursor: str, after: str | None) -> DataFrame:
    """Rows after the cursor; the filter reaches the scan."""
    return source if after is None else source.filter(F.col(cursor) > F.lit(after))


def counts_by_window(events: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Event counts by tumbling window with a watermark; works on batch and stream alike."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class Reindex:
    """Model migration: expand, backfill, validate, flip, contract; a failed step can be run again."""

    PHASES = ("idle", "expanded", "backfilled", "validated", "flipped", "contracted")

    def __init__(self, tables: Tables, encode: Callable[[DataFrame], DataFrame], model: str, dim: int):
        self.tables, self.encode, self.model, self.dim, self.phase = tables, encode, model, dim, "idle"

    def expand(self) -> None:
        self.phase = "expanded"

    def backfill(self) -> int:
        """Encodes the records that the model hasn't yet; how many that were."""
        old = self.tables.read("vectors")
        own = old.filter((F.col("model_name") == self.model) & (F.col("dim") == self.dim)).select("storage_key")
        todo = self.tables.read("records").join(own, "storage_key", "left_anti")
        n = todo.count()
        if n:
            new = self.encode(todo).select("storage_key", F.lit(self.model).alias("model_name"), F.lit(self.dim).alias("dim"), "embedding")
            self.tables.replace(vectors=old.unionByName(new.select(old.columns)))
        self.phase = "backfilled"
        return n

    def validate(self) -> None:
        """Every record has one vector of the right length with finite values."""
        v = self.tables.read("vectors").filter((F.col("model_name") == self.model) & (F.col("dim") == self.dim))
        bad = v.filter((F.size("embedding") != self.dim) | F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).count()
        if bad or v.select("storage_key").distinct().count() != self.tables.read("records").count():
            raise ValueError("the new vectors aren't complete")
        self.phase = "validated"

    def flip(self, expected: str | None) -> None:
        """Makes the model the active one if `expected` still is."""
        now = self.active()
        if now != expected:
            raise ValueError(f"the active model is {now!r}, not {expected!r}")
        self.tables.replace(active_model=self.tables.spark.createDataFrame([(self.model, self.dim, expected)], "model_name string, dim int, previous string"))
        self.phase = "flipped"

    def active(self) -> str | None:
        return self.tables.read("active_model").first()["model_name"] if self.tables.exists("active_model") else None

    def contract(self) -> None:
        """Drops the previous model's vectors after keeping a copy."""
        previous = self.tables.read("active_model").first()["previous"]
        old = self.tables.read("vectors")
        self.tables.replace(vectors_backup=old.filter(F.col("model_name") == previous) if previous else old.limit(0))
        self.tables.replace(vectors=old.filter(F.col("model_name") == self.model))
        self.phase = "contracted"

    def rollback(self) -> None:
        """Back to the previous model, with its vectors from the copy if they were dropped."""
        previous = self.tables.read("active_model").first()["previous"]
        if self.phase == "contracted":
            self.tables.replace(vectors=self.tables.read("vectors").unionByName(self.tables.read("vectors_backup")))
        self.tables.replace(active_model=self.tables.spark.createDataFrame([(previous, self.dim, None)], "model_name string, dim int, previous string"))
        self.phase = "idle"
