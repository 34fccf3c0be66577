"""Numbers in text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of a Python float literal (underscores only between digits).
_FLOAT = r"^[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"
_SIMPLE = r"^[+-]?[0-9]+(\.[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"


def number(c: Column) -> Column:
    """The double in a text cell; empty, null and unparsable cells are 0.

    Cells of digits with a sign and a point, nearly all, take one pattern and
    one cast; the whole grammar is for the others.
    """
    cell = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(cell, r"^\s+|\s+$", "")
    bare = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    special = F.when(bare == "nan", F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    simple = F.when(cell == "", F.lit(0.0)).when(cell.rlike(_SIMPLE), cell.try_cast("double"))
    return simple.when(t.rlike(_FLOAT), F.regexp_replace(t, "_", "").try_cast("double")).when(t.rlike(_SPECIAL), special).otherwise(F.lit(0.0))


def shown(value: float) -> str:
    """A number as printed: integral ones without a point, others to twelve digits."""
    return str(int(value)) if float(value).is_integer() else f"{value:.12g}"
