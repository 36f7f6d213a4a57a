"""Histograms of bytes by the number of their set bits, and classes from them.

``bins`` is native: the bytes become characters, each is translated to the digit
of its bit count, and the digits are counted.  ``bins_arrow`` counts with NumPy;
it is faster in bulk where Python workers run anyway.  Both give nine columns.
All ratios are double and are added in the order of the bins.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import fixed_values as V

BINS = [f"b{k}" for k in range(9)]
_LATIN = "".join(map(chr, range(256)))
_DIGITS = "".join(str(i.bit_count()) for i in range(256))
BIT_COUNT = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)


def bins(data: Column) -> list[Column]:
    """Columns b0..b8 of a binary column."""
    digits = F.translate(F.decode(data, "ISO-8859-1"), _LATIN, _DIGITS)
    return [(F.octet_length(data) - F.length(F.replace(digits, F.lit(str(k)), F.lit("")))).cast("long").alias(b) for k, b in enumerate(BINS)]


@F.arrow_udf(T.StructType([T.StructField(b, T.LongType()) for b in BINS]))
def bins_arrow(data: pa.Array) -> pa.Array:
    counts = np.zeros((len(data), 9), dtype=np.int64)
    for i, x in enumerate(data):
        if x.is_valid:
            counts[i] = np.bincount(BIT_COUNT[np.frombuffer(x.as_buffer(), dtype=np.uint8)], minlength=9)
    return pa.StructArray.from_arrays([pa.array(counts[:, k]) for k in range(9)], names=BINS)


def with_bins(df: DataFrame, data: str = "data") -> DataFrame:
    """``df`` with b0..b8, counted once by NumPy."""
    return df.withColumn("_bins", bins_arrow(F.col(data))).select(*df.columns, *(F.col(f"_bins.{b}").alias(b) for b in BINS))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def total() -> Column:
    return _sum([F.col(b) for b in BINS])


# Each of the following takes the total (and the mean) where a query has them as
# columns already, so that they are computed once a row.


def _guarded(x: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(x)


def density(k: int, n: Column | None = None) -> Column:
    n = total() if n is None else n
    return _guarded(F.col(BINS[k]).cast("double") / n, n)


def mean(n: Column | None = None) -> Column:
    n = total() if n is None else n
    return _guarded(_sum([F.col(b) * k for k, b in enumerate(BINS)]).cast("double") / n, n)


def variance(n: Column | None = None, m: Column | None = None) -> Column:
    n = total() if n is None else n
    m = mean(n) if m is None else m
    return _guarded(_sum([(F.lit(float(k)) - m) * (F.lit(float(k)) - m) * F.col(b).cast("double") for k, b in enumerate(BINS)]) / n, n)


def extreme_density(n: Column | None = None) -> Column:
    n = total() if n is None else n
    return _guarded((F.col("b0") + F.col("b8")).cast("double") / n, n)


def summary(n: Column | None = None) -> Column:
    """Each bin as one byte: its share of 255, cut off."""
    n = total() if n is None else n
    return F.array(*(_guarded(F.least(F.lit(255.0), F.floor(F.col(b).cast("double") / n * F.lit(255.0)).cast("double")), n).cast("int") for b in BINS))


def chi_square(n: Column | None = None) -> Column:
    """Distance from the bit counts of random bytes, on shares."""
    n = total() if n is None else n
    terms = []
    for k, b in enumerate(BINS):
        expected = F.lit(comb(8, k) / 256.0)
        off = F.col(b).cast("double") / n - expected
        terms.append(off * off / expected)
    return _guarded(_sum(terms), n)


def classify(n: Column | None = None, m: Column | None = None) -> Column:
    n = total() if n is None else n
    m = mean(n) if m is None else m
    return (
        F.when(n == 0, V.SPARSE)
        .when(extreme_density(n) > F.lit(V.SPARSE_ABOVE), V.SPARSE)
        .when(chi_square(n) < F.lit(V.RANDOM_BELOW), V.RANDOM)
        .when((m >= F.lit(V.STRUCTURED_MEAN[0])) & (m <= F.lit(V.STRUCTURED_MEAN[1])) & (variance(n, m) < F.lit(V.STRUCTURED_VARIANCE)), V.STRUCTURED)
        .otherwise(V.DENSE)
    )


def measured(df: DataFrame, data: str = "data") -> DataFrame:
    """``df`` with b0..b8, their total and their mean."""
    return with_bins(df, data).withColumn("_n", total()).withColumn("_mean", mean(F.col("_n")))


def profiled(df: DataFrame, data: str = "data") -> DataFrame:
    """``df`` with b0..b8 and the class of each byte string."""
    return measured(df, data).withColumn("class", classify(F.col("_n"), F.col("_mean"))).drop("_n", "_mean")
