"""Embedding whitening: MLlib's singular value decomposition of centred distributed rows.

Entries become integers ``floor(256 * c)``, so that sums over rows are exact in any order. The fit list is each distinct
vector once. Its rows, less the mean, are the rows of a ``RowMatrix``; the right singular vectors are the eigenvectors of the
covariance, and a squared singular value over ``n`` is its eigenvalue. The matrix's Gramian (dimension squared) is summed by
the executors and decomposed on the driver in full, which LAPACK does to double precision; the dimension bounds what reaches
the driver, the rows never do. The total variance does not come from it: it is the sum of the exact squared deviations.

Defined results. Vectors that are null, or hold a null or non-finite entry, are dropped; so are those of another length than
the most frequent one (of equally frequent lengths the larger), which have no place in its space, and empty ones. Rows without
an id stay. Components whose singular value is numerically zero (below 1e-7 of the largest, past which a Gramian cannot tell)
are left out; one distinct vector, or none, gives no rows. Squared deviations of more than 38 digits are null (the total variance is then summed in doubles). Repeated rows
each get their result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import written

EXACT = "decimal(38,0)"
#: Singular values below this share of the largest are noise of the Gramian.
LEAST_SHARE = 1e-7


def integer_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x array<long>`` of the rows whose vector is whole."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(256 * c.cast("double")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).select("vec_id", x.alias("x"))


def _deviations(x: Column, sums: Column, n: int) -> Column:
    """``n * x - S`` by dimension, exact."""
    return F.zip_with(x, sums, lambda a, s: F.lit(n).cast("decimal(18,0)") * a.cast("decimal(20,0)") - s)


def _squared(deviations: Column) -> Column:
    """The sum of squares, exact; null where 38 digits do not hold it."""
    return F.aggregate(deviations, F.lit(0).cast(EXACT), lambda a, d: F.try_add(a, F.try_multiply(d.try_cast("decimal(19,0)"), d.try_cast("decimal(19,0)"))).try_cast(EXACT))


def _dot(x: Column, mean: Column, component: list[float]) -> Column:
    return F.aggregate(F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), F.lit(component), lambda a, c: a * c), F.lit(0.0), lambda a, b: a + b)


def whiten(rows: DataFrame, *, components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each whole row of ``rows (vec_id,
    embedding)`` and each component; ``deviation`` is decimal, ``component`` counts from 1 by falling eigenvalue."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows)
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double")
    if not lengths:
        return empty
    vectors = vectors.where(F.size("x") == lengths[0].d)
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    n = fit.count()
    held = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(28,0)")).cast(EXACT).alias("s")).orderBy("pos").collect()
    sums = F.array(*[F.lit(r.s).cast(EXACT) for r in held])
    mean = F.lit([float(r.s) / n for r in held])

    squared = fit.select(_squared(_deviations(F.col("x"), sums, n)).alias("exact"), F.aggregate(_deviations(F.col("x"), sums, n), F.lit(0.0), lambda a, d: a + d.cast("double") * d.cast("double")).alias("near"))
    sums_of = squared.agg(F.try_sum("exact").alias("exact"), F.count_if(F.col("exact").isNull()).alias("wide"), F.sum("near").alias("near")).first()
    total = sums_of.near if sums_of.wide or sums_of.exact is None else sums_of.exact
    if n < 2 or not total:
        return empty
    centred = F.transform(_deviations(F.col("x"), sums, n), lambda d: d.cast("double") / n)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v"), n, len(held))
    svd = matrix.computeSVD(len(held), False, LEAST_SHARE)
    values = [float(s) ** 2 / n for s in svd.s][:components]
    across = svd.V.toArray().T[: len(values)].tolist()

    scaled = [_dot(F.col("x"), mean, axis) / F.lit(e**0.5) for axis, e in zip(across, values, strict=True)]
    projected = fit.select(*[w.alias(f"w{k}") for k, w in enumerate(scaled)])
    pairs = [(a, b) for a in range(len(values)) for b in range(a, len(values))]
    spread = projected.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = max(abs(spread[f"c{a}_{b}"] - (a == b)) for a, b in pairs)

    trace = float(total) / float(n) ** 3
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), w.alias("whitened"), F.lit(e / trace).alias("explained")) for k, (w, e) in enumerate(zip(scaled, values, strict=True))])
    made = vectors.select("vec_id", _squared(_deviations(F.col("x"), sums, n)).alias("deviation"), F.explode(each).alias("c"))
    return made.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
