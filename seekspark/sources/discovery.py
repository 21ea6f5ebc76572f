"""Files as a source: discovery by pattern, reconciliation with an index manifest, resumable bootstrap."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_suffix
from ..operators.filters import glob

SUFFIXES = (".md", ".markdown", ".txt")


def included(path: Column, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> Column:
    """Relative paths that match an include and no exclude pattern and have no hidden part."""
    hidden = path.rlike(r"(^|/)\.[^/]")
    return ~hidden & glob(path, include) & ~glob(path, exclude)


def discover(spark: SparkSession, roots: Sequence[str], include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> DataFrame:
    """(path, root, relative, modified, length) of parseable files below the roots that exist; contents aren't read."""
    def is_folder(root: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    roots = [r for r in dict.fromkeys(x.rstrip("/") for x in roots) if is_folder(r)]
    if not roots:
        return spark.createDataFrame([], "path string, root string, relative string, modified timestamp, length long")
    files = None
    for r in roots:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r).select("path", F.lit(r).alias("root"), F.substring_index("path", r.removeprefix("file:") + "/", -1).alias("relative"), F.col("modificationTime").alias("modified"), "length")
        files = f if files is None else files.union(f)
    wanted = F.lower(F.regexp_extract("relative", r"(\.[^./]+)$", 1)).isin(*SUFFIXES)
    return files.filter(wanted & included(F.col("relative"), include, exclude)).dropDuplicates(["path"]).orderBy("path")


def doc_id(relative: Column) -> Column:
    return without_suffix(relative)


def directories(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("relative", r"^(.*)/[^/]*$", 1).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def reconcile(found: DataFrame, indexed: DataFrame, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> DataFrame:
    """(doc_id, action): add what is found but not indexed; remove what is gone or no longer included. Both have (doc_id, path)."""
    ok = found.filter(included(F.col("path"), include, exclude)).select("doc_id", F.lit(True).alias("f")).distinct()
    own = indexed.select("doc_id", F.lit(True).alias("i")).distinct()
    both = ok.join(own, "doc_id", "full_outer")
    return both.filter(F.col("f").isNull() | F.col("i").isNull()).select("doc_id", F.when(F.col("i").isNull(), "add").otherwise("remove").alias("action"))


def pending(targets: DataFrame, completed: DataFrame) -> DataFrame:
    """Targets (path, modified, length) whose stamp isn't among the completed ones."""
    return targets.join(completed, ["path", "modified", "length"], "left_anti")


def generation(manifest: dict, targets: DataFrame) -> DataFrame:
    """One row: a hash of the manifest and all target paths in order."""
    text = json.dumps(manifest, sort_keys=True)
    return targets.agg(F.sha2(F.concat(F.lit(text), F.to_json(F.sort_array(F.collect_list("path")))), 256).alias("generation"))


def save_manifest(path: str, manifest: dict) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        json.dump(manifest, f)
    os.replace(tmp, path)


def load_manifest(path: str) -> dict | None:
    """None where it is missing or can't be read."""
    try:
        with open(path) as f:
            out = json.load(f)
        return out if isinstance(out, dict) else None
    except (OSError, json.JSONDecodeError):
        return None


def should_rebuild(saved: dict | None, now: dict) -> bool:
    return saved is None or not saved.get("indexed_files") or any(saved.get(k) != now.get(k) for k in ("spec_version", "embedding_model", "chunking"))


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def readiness(targets: int, done: int, failed: bool = False) -> str:
    return "failed" if failed else "ready" if done >= targets else "partial" if done else "indexing"


def semantic_tier(done: int, total: int) -> str:
    return "full" if total and done >= total else "coarse" if done else "none"
