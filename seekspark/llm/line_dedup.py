"""Operator 2: line deduplication over levelled sorted runs of line hashes.

The corpus goes by in batches of ascending doc_id. A batch's lines are hashed (128 bits), reduced
to their first occurrence, and merge-anti-joined with the runs of all earlier batches; what is
left becomes a new run. Runs are tables bucketed and sorted by hash, so that neither an anti-join
nor the run's own side of it shuffles or sorts again. When `fanout` runs stand at a level they are
compacted to one run of the next level, so a batch meets a logarithmic number of runs.
At the end the surviving occurrences are stored by document and the runs are dropped; they meet their documents
in one shuffle of the texts. Rows that repeat doc_id and text would all meet in one task there, so
of these one is taken by an aggregation with partial results before.

A line is what a line feed separates; lines are compared without spaces at either end. Of equal
lines in the whole corpus the first stays: that of the smallest doc_id (null is the largest), then
of the smallest hash of the text, then the topmost. Lines that are empty or of spaces stay.

Defined results: a document loses its row when it had a line and none is left but blank ones;
a null text, and one of blank lines only, stays as it is. Of rows that repeat doc_id and text
one stands for all, and the others have lost all lines. Texts and lines may be of any length. n_chars is the new text's length; all other columns, extra ones
included, are passed through. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_path, lean, new_path, spare_name, trim, written

#: Production parameters: batches of a corpus, and runs of a level that are compacted.
BATCHES, FANOUT = 4, 2
_LAST = (1 << 63) - 1


class Runs:
    """Sorted runs of line hashes by level."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.tables: list[tuple[str, str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = new_path(self.spark, "run")
        df.write.format("parquet").option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables.append((name, path))
        return name

    def drop(self) -> None:
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
        self.tables = []

    def unseen(self, lines: DataFrame) -> DataFrame:
        for level in self.levels:
            for run in level:
                lines = lines.join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> str:
        own = run = self._write(lines)
        for k in range(len(self.levels) + 1):
            if k == len(self.levels):
                self.levels.append([])
            self.levels[k].append(run)
            if len(self.levels[k]) < self.fanout:
                break
            merged = None
            for x in self.levels[k]:
                part = self.spark.table(x).select("h1", "h2")
                merged = part if merged is None else merged.union(part)
            run = self._write(merged.repartition(self.buckets, "h1", "h2"))
            self.levels[k] = []
        return own


def _occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, at) of the first occurrence of each line that isn't blank; at orders occurrences."""
    lines = docs.select("k0", "k1", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    at = F.struct("k0", "k1", "th", "pos")
    return lines.groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.min(at).alias("at"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` (with doc_id and text) after line deduplication, as the module's text says."""
    spark = docs.sparkSession
    lean(spark)
    keyed = docs.select(F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("k1"), F.xxhash64("text").alias("th"), "text").filter("text IS NOT NULL")
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000).alias("q")).first()["q"] or []
    bounds = [None, *(bounds if batches > 1 else []), None]
    runs, added = Runs(spark, fanout), []
    for low, high in zip(bounds, bounds[1:]):
        part = keyed
        if low is not None:
            part = part.filter(F.col("k1") > low)
        if high is not None:
            part = part.filter((F.col("k1") <= high) & ~F.col("k0"))
        added.append(runs.add(runs.unseen(_occurrences(part))))
    kept = spark.table(added[0]).select("at")
    for run in added[1:]:
        kept = kept.union(spark.table(run).select("at"))
    kept = written(kept.groupBy("at.k0", "at.k1", "at.th").agg(F.collect_list("at.pos").alias("kept")), "kept")
    runs.drop()

    names = {n: spare_name(docs, n) for n in ("k0", "k1", "th", "kept", "new", "row")}
    k0, k1, th = names["k0"], names["k1"], names["th"]
    keys = [k0, k1, th]
    out = docs.withColumns({k0: F.col("doc_id").isNull(), k1: F.coalesce("doc_id", F.lit(_LAST)).cast("long"), th: F.xxhash64("text")})
    repeated = written(keyed.filter(F.regexp_like("text", F.lit(r"[^ \n]"))).groupBy("k0", "k1", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k0", "k1", "th").toDF(*keys), "repeated")
    if not repeated.isEmpty():  # any one row of each key
        first = out.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(names["row"]))
        first = first.select(*[F.col(names["row"])[c].alias(c) for c in docs.columns], *keys)
        out = out.join(repeated, keys, "left_anti").unionByName(first)
    out = out.join(kept.toDF(*keys, names["kept"]), keys, "left")

    @F.pandas_udf("string")
    def rebuild(text: pd.Series, kept: pd.Series) -> pd.Series:
        """The text of the kept lines; null if lines were lost and only blank ones are left."""

        def one(text, kept):
            if text is None:
                return None
            kept = set() if kept is None else set(kept)
            lines = text.split("\n")
            if len(kept) == len(lines):
                return text
            stay = [x for i, x in enumerate(lines) if i in kept or not x.strip(" ")]
            return "\n".join(stay) if kept or len(stay) == len(lines) else None

        out = pd.Series([one(*x) for x in zip(text, kept)], dtype=object)
        trim()
        return out

    new = names["new"]
    out = out.withColumn(new, rebuild("text", names["kept"])).filter(F.col("text").isNull() | F.col(new).isNotNull())
    changed = {"text": F.col(new), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), ranked AS (
  SELECT doc_id, pos, line, trim(line) = '' AS blank,
         row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) AS nth
  FROM lines
), rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE blank OR nth = 1) AS new_text,
         bool_or(NOT blank AND nth = 1) AS some_kept, bool_and(blank) AS all_blank
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, r.new_text AS text, d.lang, d.source,
       CASE WHEN d.text IS NULL THEN d.n_chars ELSE length(r.new_text) END AS n_chars
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
WHERE d.text IS NULL OR r.some_kept OR r.all_blank
"""
