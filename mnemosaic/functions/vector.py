"""Vector expressions over array columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is zero. Vectors of different length raise."""
    n = norm(a) * norm(b)
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.coalesce(same, F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def cosine_lenient(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def mean_pooled(vectors: Column) -> Column:
    """The mean of an array of equally long vectors."""
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors), F.lit(1))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def _codec():
    import numpy as np
    from pyspark.sql.functions import PandasUDFType

    decode = F.pandas_udf(lambda blobs: blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4")), "array<float>", PandasUDFType.SCALAR)
    encode = F.pandas_udf(lambda vectors: vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary", PandasUDFType.SCALAR)
    return decode, encode


def from_blob(blob: Column) -> Column:
    """Little-endian 32-bit floats as an array. There is no such expression in the JVM; batches go through Arrow."""
    return _codec()[0](blob)


def to_blob(vector: Column) -> Column:
    return _codec()[1](vector.cast("array<float>"))
