"""Whitening of vectors by the singular values of their centred rows.

Entries become integers, so that sums, means and deviations are exact. The centred rows
are a distributed matrix of Spark's MLlib, whose computeSVD gives singular values and
right singular vectors from products summed over all tasks; a singular value s belongs to
the variance s * s / n. The total variance comes from the exact deviations, not from the
decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean

SCALE, SHIFT = 1024, 100_000
#: Wider vectors ask for the first components alone, by Arnoldi iterations instead of a whole decomposition on the driver.
WIDE = 1024
#: Directions whose deviation is under this share of the first one's are noise of the products, not components.
LEAST = 3e-6
#: Integers over this have sums that a long may not hold.
LARGEST = 1 << 40


def finite(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    c = F.col(vector)
    return F.coalesce(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def squares(x: Column, n: int, sums: Column) -> Column:
    """The sum over dimensions of (n * x - S)^2, exact: in longs where they hold it, else in decimals."""
    gaps = F.zip_with(x, sums, lambda a, s: a * F.lit(n) - s)
    short = F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: F.try_add(t, F.try_multiply(g, g)))
    wide = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda t, g: (t + g.cast("decimal(19,0)") * g.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return F.coalesce(short.cast("decimal(38,0)"), wide)


def principal(x: DataFrame, mean: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance as columns, by falling eigenvalue, and the eigenvalues; the largest entry of each is positive."""
    dim = len(mean)
    centred = F.zip_with("x", F.lit(mean.tolist()).cast("array<double>"), lambda a, m: a.cast("double") - m)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(centred).alias("row")), "row"), n, dim)
    svd = matrix.computeSVD(dim if dim <= WIDE else min(components, dim), computeU=False, rCond=LEAST)
    s, v = np.array(svd.s.toArray()), np.array(svd.V.toArray())
    some = np.flatnonzero(s > 0)[:components]
    v = v[:, some] / np.linalg.norm(v[:, some], axis=0)
    flip = np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(some))]) if len(some) else np.ones(0)
    return v * flip, s[some] ** 2 / n


def project(mean: np.ndarray, axes: np.ndarray):
    """mapInArrow: rows (vec_id, deviation, x) to (vec_id, deviation, w), w = (x - mean) @ axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean))
            w = (x - mean) @ axes
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    return run


def whiten_alike(rows: DataFrame, components: int) -> DataFrame | None:
    """whiten() for vectors x of one length; None where they do not vary."""
    per_dim = rows.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.sum("c").alias("s"), F.count("*").alias("n"), F.max(F.abs("c")).alias("most"))
    dims = sorted(per_dim.collect())
    if not dims:
        return None
    if max(d.most for d in dims) > LARGEST:
        raise ValueError(f"entries of over {(LARGEST - SHIFT) // SCALE} have no exact sums")
    n, sums = dims[0].n, [d.s for d in dims]
    mean = np.array([s / n for s in sums])
    deviation = squares(F.col("x"), n, F.lit(sums).cast("array<bigint>"))
    exact = checkpoint(rows.select("vec_id", deviation.alias("deviation"), "x"))
    total = int(exact.agg(F.sum("deviation").cast("decimal(38,0)")).first()[0])
    if total == 0:
        return None
    axes, variance = principal(exact, mean, n, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    white = exact.mapInArrow(lean(project(mean, axes / np.sqrt(variance))), f"vec_id {kind}, deviation decimal(38,0), w array<double>")
    k = len(variance)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = white.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    trace = total / n**3
    explained = F.get(F.lit((variance / trace).tolist()).cast("array<double>"), F.col("component") - 1)
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("component", "whitened")).withColumn("component", (F.col("component") + 1).cast("int"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): one for each vector and component.

    An entry c counts as floor(1024 * c) + 100000. Vectors that are null or hold null or
    non-finite entries are left out; all others are fitted and whitened. There are as many
    components as the vectors vary in directions, ``components`` at most: vectors that are
    all equal, or a single one, give no rows. identity_error is one number for all.
    deviation is null where no long holds it; entries of over 2^30 raise an error.

    Null ids and repeated rows count and come out each. Vectors of different lengths are
    fitted apart. Extra columns are ignored. An empty table gives an empty result. The
    driver holds one square matrix of a vector's length and nothing for each row.
    """
    spark = vectors.sparkSession
    far = float(2 * LARGEST)  # what is over LARGEST raises an error, whatever it is
    x = F.transform(F.col(vector), lambda c: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), c.cast("double") * SCALE))).cast("long") + SHIFT)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(finite(vector), x).alias("x")).where("x IS NOT NULL")
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    found = [w for d in lengths if (w := whiten_alike(rows.where(F.size("x") == d), components)) is not None]
    if not found:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return reduce(DataFrame.union, found)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
