"""Whitening of embeddings by the exact statistics of their distinct vectors.

Entries become integers, so that sums and the centring are exact: n·x − S is a whole number, and only its
division by n is rounded. The Gramian of the centred rows (MLlib's ``RowMatrix``) over n is the covariance; its
leading eigenvectors are found on the driver, as it holds one number for each pair of dimensions, and are sent to
the tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tamarack.llm import common
from tamarack.scratch import Scratch
from tamarack.session import ship

COMPONENTS = 16
#: Most dimensions: the driver holds a square of them (128 MiB), each task ``COMPONENTS`` numbers for each.
MOST_DIMENSIONS = 4096
#: Components whose variance is under this share of the largest one are rounding error and left out.
NEGLIGIBLE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``sums`` over ``n`` distinct vectors, and the components (columns) by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def quantised(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry c as a long; null where the vector is null, empty, or holds null, NaN or an infinite entry."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    whole = F.transform(entries, lambda c: F.floor(c * 64).cast("long") + F.lit(1_000_000).cast("long"))
    return F.when((F.size(vector) > 0) & ~F.exists(entries, bad), whole)


def _centred(x: Column, n: int, sums: list[int]) -> Column:
    """n·x − S of each entry, exact."""
    return F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in sums]), lambda v, s: v * F.lit(n).cast("long") - s)


def _covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Gramian of a column ``row`` of doubles, over n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def _project(matrix: np.ndarray, n: int):
    """Whitened entries of ``centred``: over n, then by the matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = np.array(batch["centred"].tolist(), dtype=np.float64) / n
                yield batch.assign(whitened=list(rows @ matrix.value))

    return run


def _whitened(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """The rows with ``whitened``, in the place of one of that name, from their ``centred``."""
    matrix = rows.sparkSession.sparkContext.broadcast(fitted.components / np.sqrt(fitted.variances))
    return rows.mapInPandas(_project(matrix, fitted.n), StructType([*rows.schema, StructField("whitened", ArrayType(DoubleType()))]))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Statistics of the column ``x`` (array of long, all of one length, each vector once); None where there is no variance."""
    sums = {r.at: (r.n, r.total) for r in distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()}
    if not sums:
        return None
    n, totals = sums[0][0], [sums[i][1] for i in range(len(sums))]
    values, vectors = np.linalg.eigh(_covariance(distinct.select(F.transform(_centred(F.col("x"), n, totals), lambda v: v / F.lit(float(n))).alias("row")), n))
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(components, int((values > NEGLIGIBLE * max(values[0], 0)).sum()))
    return Whitening(n, totals, vectors[:, :some], values[:some], values[:some] / values.sum()) if some else None


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity, measured on them."""
    k = len(fitted.variances)
    rows = _whitened(distinct.select(_centred(F.col("x"), fitted.n, fitted.sums).alias("centred")), fitted).select("whitened")
    means = rows.agg(F.array(*[F.avg(F.col("whitened")[i]) for i in range(k)]).alias("m")).head().m
    row = F.zip_with("whitened", F.array(*map(F.lit, means)), lambda v, m: v - m).alias("row")
    return float(np.abs(_covariance(rows.select(row), fitted.n) - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """The rows of ``vectors`` with ``x`` (quantised), ``centred`` (n·x − S) and ``whitened``, what was fitted, and its identity error.

    Rows whose vector is null, empty, or holds a null or non-finite entry go, as do those whose length is not the
    commonest among the rest (of equally common ones the longest). Repeated rows stay, and count once for the
    statistics. Columns that have one of the three names are replaced. No row left, or rows that are all equal, give no
    rows and None twice. Components without variance are left out, equal variances keep the order that the
    eigensolver gives. n·x beyond 2^63 is an error, not a wrong number; so are more than ``MOST_DIMENSIONS`` dimensions.
    """
    spark = vectors.sparkSession
    ship(spark)
    tables = Scratch(spark, "whitening")
    own = ("x", "centred", "whitened")
    x = quantised(F.col(column))
    distinct = tables.keep(vectors.select(x.alias("x")).where("x is not null").distinct(), "distinct")
    lengths = vectors.where(x.isNotNull()).groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0].length if lengths else 0
    if length > MOST_DIMENSIONS:
        raise ValueError(f"{length} dimensions, more than {MOST_DIMENSIONS}")
    distinct = distinct.where(F.size("x") == length)
    fitted = fit(distinct, components)
    rows = vectors.select(*[c for c in vectors.columns if c not in own], x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == length))
    if not fitted:
        schema = StructType([*rows.schema, StructField("centred", ArrayType(LongType())), StructField("whitened", ArrayType(DoubleType()))])
        return spark.createDataFrame([], schema), None, None
    centred = rows.withColumn("centred", _centred(F.col("x"), fitted.n, fitted.sums))
    return _whitened(centred, fitted), fitted, identity_error(distinct, fitted)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened entries of every valid row of ``embeddings``, one row for each of its components; see ``whiten``."""
    rows, fitted, error = whiten(common.load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = fitted.explained.tolist() if fitted else []
    square = F.aggregate("centred", F.lit(0).cast("long"), lambda total, v: total + v * v)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), square.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n if fitted else None).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
