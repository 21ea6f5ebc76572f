"""Write side: changes as DataFrame programs, and snapshot tables on plain Parquet with an epoch pointer."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields whose change concerns the keyword index and the vectors.
KEYWORD_FIELDS, VECTOR_FIELDS = ("title", "body", "uri", "keywords"), ("title", "body")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset, if the session is a local one, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="seekspark-tables-"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/seekspark-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """`df` as a table in the shared folder, reread: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def latest(batch: DataFrame, order: str, key: str = "storage_key") -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def diff(old: DataFrame, batch: DataFrame, key: str = "storage_key") -> DataFrame:
    """(key, change, keyword_changed, vector_changed) of the batch's rows: insert, update or none."""
    fields = [c for c in batch.columns if c != key and c in old.columns]
    joined = batch.alias("n").join(old.withColumn("_there", F.lit(True)).alias("o"), key, "left")
    new = F.col("_there").isNull()

    def changed(names: Sequence[str]):
        out = F.lit(False)
        for f in names:
            if f in fields:
                out = out | ~F.col(f"n.{f}").eqNullSafe(F.col(f"o.{f}"))
        return new | out

    return joined.select(key, F.when(new, "insert").when(changed(fields), "update").otherwise("none").alias("change"), changed(KEYWORD_FIELDS).alias("keyword_changed"), changed(VECTOR_FIELDS).alias("vector_changed"))


def upsert(old: DataFrame, batch: DataFrame, key: str | Sequence[str] = "storage_key") -> DataFrame:
    """old with the batch's rows in place of those of the same key."""
    return old.join(batch, key, "left_anti").unionByName(batch.select(old.columns))


def delete(keys: DataFrame, records: DataFrame, vectors: DataFrame, edges: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """All tables without the keys (storage_key), their chunks, and edges at either end."""
    k = keys.select("storage_key").distinct()
    own = k.union(chunks.join(k, chunks.parent_key == k.storage_key, "left_semi").select("chunk_key")).distinct()
    return {
        "records": records.join(own, "storage_key", "left_anti"),
        "vectors": vectors.join(own, "storage_key", "left_anti"),
        "edges": edges.join(own, edges.src_key == own.storage_key, "left_anti").join(own, F.col("dst_key") == own.storage_key, "left_anti"),
        "chunks": chunks.join(own, chunks.parent_key == own.storage_key, "left_anti").join(own, F.col("chunk_key") == own.storage_key, "left_anti"),
    }


def delete_for_model(vectors: DataFrame, keys: DataFrame, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors without the model's rows of the keys, keys that have no vector left)."""
    k = keys.select("storage_key").distinct()
    gone = vectors.filter((F.col("model_name") == model) & (F.col("dim") == dim)).join(k, "storage_key", "left_semi")
    rest = vectors.join(gone.select("storage_key", "model_name", "dim"), ["storage_key", "model_name", "dim"], "left_anti")
    return rest, k.join(rest.select("storage_key"), "storage_key", "left_anti")


def sync_chunks(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunk state with each incoming parent's set replaced as a whole."""
    return old.join(incoming.select("parent_key").distinct(), "parent_key", "left_anti").unionByName(incoming.select(old.columns))


def upsert_edges(old: DataFrame, batch: DataFrame, records: DataFrame) -> DataFrame:
    """Edges by (src, dst, type); raises for an empty type, a weight that isn't finite, or an end without a record."""
    w = F.col("weight")
    bad = batch.filter((F.coalesce(F.trim("edge_type"), F.lit("")) == "") | w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    ends = batch.select(F.explode(F.array("src_key", "dst_key")).alias("storage_key"))
    loose = ends.join(records.select("storage_key"), "storage_key", "left_anti")
    if not bad.isEmpty() or not loose.isEmpty():
        raise ValueError("edges need a type, a finite weight and records at both ends")
    return upsert(old, batch, ["src_key", "dst_key", "edge_type"])


def delete_edges(old: DataFrame, batch: DataFrame) -> DataFrame:
    return old.join(batch, ["src_key", "dst_key", "edge_type"], "left_anti")


def current_vectors(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vectors whose stored revision is the wanted one."""
    return vectors.join(wanted.select("storage_key", "revision"), ["storage_key", "revision"], "left_semi")


def check_index(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(storage_key, error): records that the index lacks, and indexed documents without a record."""
    missing = records.select("storage_key").join(documents.select("storage_key"), "storage_key", "left_anti").withColumn("error", F.lit("not indexed"))
    orphan = documents.select("storage_key").join(records.select("storage_key"), "storage_key", "left_anti").withColumn("error", F.lit("orphan"))
    return missing.union(orphan)


def read_text(fs, path) -> str:
    source = fs.open(path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(fs, path_class, path: str, text: str) -> None:
    """A file that is there whole or not at all: written beside and renamed. Raises if it exists."""
    tmp = path_class(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(tmp, path_class(path)):
        fs.delete(tmp, False)
        raise OSError(f"{path} exists")


class Tables:
    """Named tables under a folder: each write is a new snapshot, and a pointer file with an epoch names the current ones.

    A write never touches what a running plan reads: pointers are files with ascending numbers, made under another
    name and renamed, and the one of highest number counts, so a crash at any moment leaves the last whole state.
    The epoch of a table rises only when it is replaced. Snapshots that the last KEEP pointers don't name are
    dropped. One writer at a time.
    """

    KEEP = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._path = fs.Path
        self._fs = fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(fs.Path(self.root))

    def _state(self) -> dict:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {}

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)))
        return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(r"current-(\d{12})\.json", n)))

    def _read(self, number: int) -> dict:
        return json.loads(read_text(self._fs, self._path(f"{self.root}/current-{number:012d}.json")))

    def epoch(self, name: str) -> int:
        return self._state().get(name, {}).get("epoch", 0)

    def exists(self, name: str) -> bool:
        return name in self._state()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._state()[name]["path"])

    def replace(self, **tables: DataFrame) -> None:
        """Writes all snapshots first, then moves the pointer once, so readers see all of a change or nothing."""
        state = self._state()
        for name, df in tables.items():
            path = f"{self.root}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            state[name] = {"path": path, "epoch": state.get(name, {}).get("epoch", 0) + 1}
        self._point(state)

    def _point(self, state: dict) -> None:
        numbers = self._numbers()
        write_text(self._fs, self._path, f"{self.root}/current-{numbers[-1] + 1 if numbers else 0:012d}.json", json.dumps(state))
        numbers = self._numbers()
        named = {t["path"] for n in numbers[-self.KEEP :] for t in self._read(n).values()}
        for n in numbers[: -self.KEEP]:
            for table in self._read(n).values():
                if table["path"] not in named:
                    self._fs.delete(self._path(table["path"]), True)
            self._fs.delete(self._path(f"{self.root}/current-{n:012d}.json"), False)

    def upsert(self, name: str, batch: DataFrame, key: str | Sequence[str] = "storage_key") -> bool:
        """Replaces the table only if a row is new or differs; whether it did."""
        if not self.exists(name):
            self.replace(**{name: batch})
            return True
        old = self.read(name)
        if batch.select(old.columns).exceptAll(old).isEmpty():
            return False
        self.replace(**{name: upsert(old, batch, key)})
        return True


class Checkpoints:
    """Cursors by (workspace, kind): numbered JSON files in a folder of any file system, the last of which counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(r"cursor-(\d{12})\.json", n)))

    def _all(self) -> dict[str, str]:
        numbers = self._numbers()
        return json.loads(read_text(self._fs, self._path(f"{self.folder}/cursor-{numbers[-1]:012d}.json"))) if numbers else {}

    def get(self, workspace: str | None, kind: str) -> str | None:
        return self._all().get(json.dumps([workspace, kind]))

    def set(self, workspace: str | None, kind: str, cursor: str) -> None:
        state, numbers = self._all() | {json.dumps([workspace, kind]): cursor}, self._numbers()
        write_text(self._fs, self._path, f"{self.folder}/cursor-{numbers[-1] + 1 if numbers else 0:012d}.json", json.dumps(state))
        for n in numbers[:-1]:
            self._fs.delete(self._path(f"{self.folder}/cursor-{n:012d}.json"), False)
