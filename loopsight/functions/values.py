"""Cells of text tables as numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopsight.functions.cyclic import finite


def number(cell: Column) -> Column:
    """A finite double; blanks, words and NaN are null."""
    return finite(F.trim(cell.cast("string")).try_cast("double"))


def whole(cell: Column) -> Column:
    """A long; also of text such as 7.0, but null for 7.5."""
    x = number(cell)
    return F.when(x == F.floor(x), x.cast("long"))


def truthy(cell: Column, default: bool = False) -> Column:
    """Whether a cell says 1, true, yes or on, in any case; missing cells have the default."""
    said = F.lower(F.trim(cell.cast("string"))).isin("1", "true", "yes", "on")
    return F.coalesce(said, F.lit(default))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
