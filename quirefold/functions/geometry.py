"""Column expressions over boxes (points, top-left origin) and arithmetic used with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}{name}")


def width(p: str = "") -> Column:
    return col("x1", p) - col("x0", p)


def height(p: str = "") -> Column:
    return col("y1", p) - col("y0", p)


def area(p: str = "") -> Column:
    return width(p) * height(p)


def centre_x(p: str = "") -> Column:
    return (col("x0", p) + col("x1", p)) / 2


def centre_y(p: str = "") -> Column:
    return (col("y0", p) + col("y1", p)) / 2


def valid_box(p: str = "") -> Column:
    """Finite and ordered; a null edge makes it invalid."""
    edges = [col(c, p) for c in ("x0", "y0", "x1", "y1")]
    finite = F.lit(True)
    for e in edges:
        finite = finite & e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(1e300))
    return F.coalesce(finite & (col("x0", p) <= col("x1", p)) & (col("y0", p) <= col("y1", p)), F.lit(False))


def contains_centre(outer: str, inner: str = "") -> Column:
    """The centre of the inner box lies in the outer one, edges included."""
    return centre_x(inner).between(col("x0", outer), col("x1", outer)) & centre_y(inner).between(col("y0", outer), col("y1", outer))


def y_overlap(a: str, b: str) -> Column:
    return F.least(col("y1", a), col("y1", b)) - F.greatest(col("y0", a), col("y0", b))


def x_overlap(a: str, b: str) -> Column:
    return F.least(col("x1", a), col("x1", b)) - F.greatest(col("x0", a), col("x0", b))


def plausible_word(page_width: Column, page_height: Column, tolerance: float = 2.0) -> Column:
    """A word box of positive size inside its page and of a size that words have."""
    return (
        (width() > 0)
        & (height() > 0)
        & (F.col("x0") >= -tolerance)
        & (F.col("y0") >= -tolerance)
        & (F.col("x1") <= page_width + tolerance)
        & (F.col("y1") <= page_height + tolerance)
        & (height() <= F.greatest(F.lit(144.0), page_height * 0.25))
        & (width() <= F.greatest(F.lit(288.0), page_width * 0.8))
    )


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up by the same arithmetic in every engine."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def enclosing() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def index_quantile(values: Column, q: float) -> Column:
    """The value at index int(q * (n - 1)) of the sorted values; the array must be bounded (a page)."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.floor(q * (F.size(ordered) - 1)) + 1).cast("int"))
