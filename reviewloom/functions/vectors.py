"""Vector expressions over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_vector(values: Sequence[float]) -> Column:
    """A constant array<double>, folded into the plan."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors of unequal length are an error."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(
        a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def unit(a: Column, to: str = "float") -> Column:
    """Scale to length one as an array of `to`; a zero vector stays zero."""
    # The length is bound as a lambda variable, or it would be computed per element.
    scaled = F.transform(
        F.array(norm(a)),
        lambda length: F.transform(
            a, lambda x: F.when(length == 0, x).otherwise(x.cast("double") / length).cast(to)
        ),
    )
    return F.element_at(scaled, 1)
