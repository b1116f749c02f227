"""Vector expressions over array columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 9


def double(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str, eps: float = 1e-12) -> Column:
    """The vector over its norm; a norm under eps raises, since cosine is undefined for it."""
    # The norm is bound as the one element of an array, so that it is taken once a vector and not once a coordinate.
    checked = lambda n: F.when(n < eps, F.raise_error(F.lit("a vector has almost no norm; cosine distance is undefined for it"))).otherwise(n)
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / checked(n)))[0]


def rounded(x: Column) -> Column:
    """x to PLACES places, half away from zero in doubles as SQL engines round; means of rounded values often end in a half."""
    return F.round(x * 10.0**PLACES) / 10.0**PLACES


def clipped(cosine: Column) -> Column:
    """Cosine distance of a cosine, in [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - cosine))


def finite(v: Column | str) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def nearest(v: Column | str, prototypes: Column | str) -> Column:
    """Of an array of (proto_id, centroid), the nearest by cosine: (cluster, distance), the first id on ties.

    A projection: no join, no explode and no shuffle beyond the one row of prototypes.
    """
    scored = F.transform(prototypes, lambda p: F.struct(F.round(dot(v, p["centroid"]), PLACES).alias("sim"), (-p["proto_id"]).alias("order")))
    best = F.array_max(scored)
    return F.struct((-best["order"]).alias("cluster"), F.round(clipped(best["sim"]), PLACES).alias("distance"))
