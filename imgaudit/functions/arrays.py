"""Feature arrays and linear models as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def combine_features(semantic: Column, frequency: Column | None = None) -> Column:
    return semantic if frequency is None else F.concat(semantic, frequency)


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double") / norm(values))


def margin(values: Column, mean: Column, std: Column, weights: Column, bias: Column) -> Column:
    """weights . (values - mean) / std + bias."""
    terms = F.zip_with(F.zip_with(F.zip_with(values, mean, lambda v, m: v.cast("double") - m), std, lambda v, s: v / s), weights, lambda v, w: v * w)
    return F.aggregate(terms, bias.cast("double"), lambda acc, x: acc + x)


def probability(m: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-m))


def metadata_features(width: Column, height: Column, size: Column) -> Column:
    """log1p of width, height and bytes, and the log of the aspect ratio."""
    w, h = width.cast("double"), height.cast("double")
    return F.array(F.log1p(w), F.log1p(h), F.log1p(size.cast("double")), F.log(w / h))


def sign_hash(values: Column) -> Column:
    """64 sign bits of a 64-vector as one long, the first value in the top bit."""
    bits = F.transform(F.slice(values, 1, 64), lambda x: F.when(x > 0, "1").otherwise("0"))
    text = F.array_join(bits, "")
    high, low = F.conv(F.substring(text, 1, 32), 2, 10).cast("long"), F.conv(F.substring(text, 33, 32), 2, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)
