"""Operator 10: quality rules as robust multivariate outliers.

Each document becomes a vector of six transformed statistics. For each language and source the
centre and covariance of the bulk are estimated by minimum covariance determinant, and documents
whose Mahalanobis distance to them is beyond a chi-squared quantile are rejected.

Statistics, all independent of a text's length but for chance: share of symbols; square roots of
the shares of punctuation, of upper case among letters, and of words for each character; share of
characters in lines that repeat a line above; Herdan's measure log(distinct words) / log(words).
A share is shrunk towards the median share of the language (of all documents, where those judge) by
a weight of PRIOR characters, so that a short text isn't extreme by chance. FLOORS are the least standard deviations that matter; their
squares are added to each covariance, which so is never singular.

The estimate is deterministic and distributed. Two starts (medians with scaled absolute deviations;
spatial signs) are each improved by concentration steps until the determinants stop falling. A step
is one aggregation: distances fall into bins of about 3 %, with count, sums and sums of products
in each, and the bins that hold the nearest `SUBSET` of the rows give the next centre and
covariance. The start with the smaller determinant is reweighted once (97.5 % quantile).
All rows take part; nothing is sampled. Estimates are tables, a row for each group, whose matrices
are inverted in batches; the driver only asks whether any group is still improving, so sources may be
as many as hosts are. They meet the rows in a broadcast up to BROADCAST_BYTES, in a shuffle join beyond.

A group of fewer than MIN_ROWS rows has too few for six dimensions: it is judged by the estimate of
its language, and where that has too few by that of all documents, with shares shrunk to the
medians of the same. Where even those are too few, none is judged and all stay.

Texts are counted twice, for the estimate and for the decision, so that the corpus is neither written
with its counts nor shuffled to them.

Defined results: a null text, or one without words, has no statistics and stays; null and empty
lang or source are one group; repeated rows count as often as they occur; texts are counted whole, however
long; distances at the cut, and equal ones, are decided alike; all columns, extra ones included, are
passed through. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, lean, spare_name, trim, written

#: Production parameters.
QUANTILE, SUBSET, MIN_ROWS, PRIOR = 0.999, 0.75, 60, 400
FLOORS = np.array([0.015, 0.02, 0.02, 0.01, 0.08, 0.02])
D = len(FLOORS)
_STEPS = 30
#: Up to these bytes the groups' estimates are broadcast; a larger table is joined by shuffle.
BROADCAST_BYTES, _GROUP_BYTES = 32 << 20, 400
_SHARES = [("symbols", "chars"), ("marks", "chars"), ("upper", "letters"), ("words", "chars"), ("repeated", "chars")]
_COUNTS = ["chars", "letters", "upper", "marks", "symbols", "words", "distinct", "repeated"]

_KIND = np.zeros(256, np.uint8)  # 0: symbol, 1: lower or other letter, 2: upper, 3: punctuation, 4: white space, 5: digit, 6: inside a character
_KIND[0x80:0xC0] = 6
_KIND[0xC0:] = 1
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 3
_KIND[[*range(9, 14), 32]] = 4
_KIND[[*range(48, 58)]] = 5


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(d: int, p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_share(d / 2, middle / 2) < p else (low, middle)
    return high


def consistency(d: int, share: float) -> float:
    """What the covariance of a normal sample's nearest `share` is to be multiplied by."""
    return share / gamma_share(d / 2 + 1, chi2_quantile(d, share) / 2)


def count_text(text: str | None) -> tuple | None:
    """The counts of _COUNTS; None without a word."""
    words = text.split() if text else []
    if not words:
        return None
    kind = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=7)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(map(len, lines)) - sum(map(len, set(lines))) if len(lines) > 1 else 0
    return len(text), int(kind[1] + kind[2]), int(kind[2]), int(kind[3]), int(kind[0]), len(words), len(set(words)), repeated


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _COUNTS]))
def counts(text: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([count_text(t) or (None,) * len(_COUNTS) for t in text], columns=_COUNTS, dtype=float)
    trim()
    return out


def vector(c: Column, medians: Column) -> list[Column]:
    """The statistics from a struct of counts and the array of median shares that they are shrunk to."""
    shares = [(c[k] + PRIOR * medians[i]) / (c[of] + PRIOR) for i, (k, of) in enumerate(_SHARES)]
    return [shares[0], F.sqrt(shares[1]), F.sqrt(shares[2]), F.sqrt(shares[3]), shares[4], F.log(c["distinct"] + 20) / F.log(c["words"] + 20)]


def _medians(values: list[Column], rows: DataFrame, key: str, width: float) -> DataFrame:
    """(key, m): the lower medians of the values, by counts in bins of `width`: the same in any partitioning."""
    long = rows.select(key, F.posexplode(F.array(*values)).alias("i", "v")).filter("v IS NOT NULL")
    binned = long.groupBy(key, "i", F.floor(F.col("v") / width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    binned = binned.selectExpr(key, "i", "bin", f"sum(c) OVER (PARTITION BY {key}, i ORDER BY bin) AS upto", f"sum(c) OVER (PARTITION BY {key}, i) AS n")
    middle = binned.filter("2 * upto >= n").groupBy(key, "i").agg((F.min("bin") * width).alias("m"))
    return middle.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """`df` of so many rows for a join: broadcast up to BROADCAST_BYTES."""
    return F.broadcast(df) if rows * _GROUP_BYTES <= BROADCAST_BYTES else df


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(D)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(D)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(D) for j in range(i, D)])


def _moments(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means (rows, D) and covariances (rows, D, D)."""
    n = sums["n"].to_numpy(float)
    mean = sums[[f"s{i}" for i in range(D)]].to_numpy(float) / n[:, None]
    cov = np.stack([np.stack([sums[f"p{min(i, j)}_{max(i, j)}"].to_numpy(float) / n for j in range(D)], 1) for i in range(D)], 1)
    return mean, cov - mean[:, :, None] * mean[:, None, :]


def distance(x: list[Column], centre: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance; precision is the upper triangle by rows, twice its off-diagonal."""
    out, k = F.lit(0.0), 0
    for i in range(D):
        for j in range(i, D):
            out = out + precision[k] * (x[i] - centre[i]) * (x[j] - centre[j])
            k += 1
    return out


_UPPER = np.triu_indices(D)
_TWICE = np.where(_UPPER[0] == _UPPER[1], 1.0, 2.0)
#: An estimate: centre, covariance by rows, precision as `distance` wants it, logarithm of the determinant.
_ESTIMATE = "start int, c array<double>, cov array<double>, p array<double>, det double"


def _estimates(unit: pd.Series, start: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    p = np.linalg.inv(cov)[:, _UPPER[0], _UPPER[1]] * _TWICE
    return pd.DataFrame({"unit": unit, "start": start.astype(np.int32), "c": list(centre), "cov": list(cov.reshape(-1, D * D)), "p": list(p), "det": np.linalg.slogdet(cov)[1]})


def estimate(vectors: DataFrame) -> DataFrame:
    """(unit, start, c, cov, p, det): the estimate of each `unit` of (unit, x0, ..., x5), a written table."""
    ridge, x = np.diag(FLOORS**2), [F.col(f"x{i}") for i in range(D)]
    schema = f"unit {vectors.schema['unit'].dataType.simpleString()}, {_ESTIMATE}"
    middle = written(_medians([x[i] / float(FLOORS[i]) for i in range(D)], vectors, "unit", 0.125).select("unit", F.array(*[F.col("m")[i] * float(FLOORS[i]) for i in range(D)]).alias("centre")), "middle")
    units = middle.count()
    away = vectors.join(_small(middle, units), "unit")
    spread = _medians([F.abs(x[i] - F.col("centre")[i]) / float(FLOORS[i]) for i in range(D)], away, "unit", 0.125)
    d = [F.sqrt(F.pow(1.4826 * F.col("m")[i] * float(FLOORS[i]), F.lit(2)) + float(FLOORS[i] ** 2)) for i in range(D)]
    first = written(spread.join(middle, "unit").select("unit", "centre", F.array(*d).alias("d")), "first")
    signs = vectors.join(_small(first, units), "unit")
    z = [(x[i] - F.col("centre")[i]) / F.col("d")[i] for i in range(D)]
    norm = F.sqrt(sum((a * a for a in z), F.lit(1e-12)))
    signs = _sums(signs.select("unit", *[(a / norm).alias(f"x{i}") for i, a in enumerate(z)]), ["unit"]).join(first, "unit")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            centre, d = (np.array(b[k].tolist(), float).reshape(len(b), D) for k in ("centre", "d"))
            mean, cov = _moments(b)
            diagonal = np.zeros((len(b), D, D))
            diagonal[:, range(D), range(D)] = d**2
            yield _estimates(b["unit"], np.zeros(len(b)), centre, diagonal)
            yield _estimates(b["unit"], np.ones(len(b)), centre, D * (cov + mean[:, :, None] * mean[:, None, :]) * d[:, :, None] * d[:, None, :] + ridge)

    def step(now: DataFrame, share: float | None) -> DataFrame:
        """The estimates from the nearest `share` of each unit's rows; from those within the 97.5 % quantile if None."""
        rows = vectors.join(_small(now.select("unit", "start", "c", "p"), 2 * units), "unit").withColumn("d2", distance(x, F.col("c"), F.col("p")))
        if share is None:
            sums = _sums(rows.filter(F.col("d2") <= chi2_quantile(D, 0.975)), ["unit", "start"]).withColumn("held", F.lit(0.975))
        else:
            binned = _sums(rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * 32)), ["unit", "start", "bin"])
            before = "sum(n) OVER (PARTITION BY unit, start ORDER BY bin) - n"
            total = "sum(n) OVER (PARTITION BY unit, start)"
            near = binned.withColumns({"before": F.expr(before), "total": F.expr(total)}).filter(F.col("before") < F.ceil(F.col("total") * share))
            sums = near.groupBy("unit", "start").agg(*[F.sum(k).alias(k) for k in binned.columns if k not in ("unit", "start", "bin")], F.max("total").alias("total"))
            sums = sums.withColumn("held", F.least(F.lit(1.0), F.col("n") / F.col("total")))  # the subset has all of its last bin

        def after(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                mean, cov = _moments(b)
                grow = np.array([consistency(D, h) if h < 1 else 1.0 for h in b["held"]])
                yield _estimates(b["unit"], b["start"].to_numpy(), mean, cov * grow[:, None, None] + ridge)

        return sums.mapInPandas(after, schema)

    now, done = written(signs.mapInPandas(starts, schema), "starts"), None
    for k in range(_STEPS):
        old = now.select("unit", "start", *[F.col(n).alias(f"old_{n}") for n in ("c", "cov", "p", "det")])
        both = step(now, SUBSET).join(old, ["unit", "start"])
        ended = F.lit(k > 0) & (F.col("det") >= F.col("old_det") - 1e-3)
        keeps = ended & (F.col("old_det") <= F.col("det"))
        both = written(both.select("unit", "start", *[F.when(keeps, F.col(f"old_{n}")).otherwise(F.col(n)).alias(n) for n in ("c", "cov", "p", "det")], ended.alias("ended")), "step")
        own = both.filter("ended").drop("ended")
        done, now = own if done is None else done.union(own), both.filter("NOT ended").drop("ended")
        if now.isEmpty():
            break
    done = done.union(now)
    best = done.groupBy("unit").agg(F.min_by(F.struct("c", "cov", "p", "det"), F.struct("det", "start")).alias("e"))
    chosen = written(best.select("unit", F.lit(0).alias("start"), "e.*"), "chosen")
    final = step(chosen, None).select("unit", *[F.col(n).alias(f"new_{n}") for n in ("c", "cov", "p", "det")])
    return chosen.join(final, "unit", "left").select("unit", "start", *[F.coalesce(f"new_{n}", n).alias(n) for n in ("c", "cov", "p", "det")])


def scored(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """`docs` with a last column, the squared distance (null without statistics), named distance or, if that is taken, _distance."""
    lean(docs.sparkSession)
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    names = {n: spare_name(docs, n) for n in ("l", "s", "k", "own", "c", "p", "distance")}
    rows = written(docs.select(lang.alias("l"), source.alias("s"), counts("text").alias("k")).filter("k.words IS NOT NULL"), "counts")
    sizes = rows.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("l")
    sizes = written(sizes.withColumns({"of": F.sum("n").over(by_lang), "mixed": F.min("n").over(by_lang) < min_rows}), "groups")
    groups, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if total < min_rows:  # no estimate of anything
        return docs.withColumn(names["distance"], F.lit(None).cast("double"))
    shares = [F.coalesce(F.col(f"k.{a}") / F.nullif(F.col(f"k.{b}"), F.lit(0.0)), F.lit(0.0)) for a, b in _SHARES]
    whole = F.array(*map(F.lit, _medians(shares, rows.withColumn("every", F.lit(0)), "every", 1 / 4096).first()["m"]))
    langs = _medians(shares, rows, "l", 1 / 4096)
    rare = not sizes.filter(F.col("of") < min_rows).isEmpty()  # a language too small for an estimate of its own
    shrink = F.when(F.col("of") >= min_rows, F.col("m")).otherwise(whole)
    units = [
        F.when(F.col("n") >= min_rows, F.struct(F.to_json(F.array("l", "s")).alias("unit"), shrink.alias("m"))),
        F.when((F.col("of") >= min_rows) & F.col("mixed"), F.struct(F.to_json(F.array("l")).alias("unit"), shrink.alias("m"))),
        F.when(F.lit(rare), F.struct(F.lit("[]").alias("unit"), whole.alias("m"))),
    ]
    members = written(sizes.join(langs, "l").select("l", "s", F.filter(F.array(*units), lambda u: u.isNotNull()).alias("units")), "members")
    x = vector(F.col("k"), F.col("u.m"))
    vectors = rows.join(_small(members, groups), ["l", "s"]).select("k", F.explode("units").alias("u")).select("u.unit", *[a.alias(f"x{i}") for i, a in enumerate(x)])
    found = estimate(written(vectors, "vectors")).select("unit", "c", "p")
    judges = members.select("l", "s", F.col("units")[0].alias("u")).select("l", "s", F.col("u.m").alias("own"), "u.unit").join(found, "unit")
    params = written(judges.select(*[F.col(n).alias(names[n]) for n in ("l", "s", "own", "c", "p")]), "params")
    out = docs.withColumns({names["l"]: lang, names["s"]: source, names["k"]: counts("text")}).join(_small(params, groups), [names["l"], names["s"]], "left")
    x = vector(F.col(names["k"]), F.col(names["own"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], distance(x, F.col(names["c"]), F.col(names["p"])).alias(names["distance"]))


def reject_outliers(docs: DataFrame, quantile: float = QUANTILE, min_rows: int = MIN_ROWS) -> DataFrame:
    """`docs` (with text, lang and source) without the rejected documents."""
    out = scored(docs, min_rows)
    far = F.col(f"`{out.columns[-1]}`") > chi2_quantile(D, quantile)
    return out.filter(~F.coalesce(far, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_outliers(documents(spark, sf_dir))
