"""AVG and MAX of a column, with a filter on the values and a stand-in for no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Aggregator, ColumnType, CompareExpression, CompareOp


def passes(value: Column, kind: ColumnType, test: CompareExpression) -> Column:
    """The numeric comparison; it is false for NaN, and 0.0 equals -0.0."""
    kind.check(test.value, "the filter")
    literal = F.lit(test.value).cast(kind.spark)
    held = value == literal if test.op is CompareOp.EQUAL else value > literal
    return held & ~F.isnan(value) if kind is ColumnType.DOUBLE_FLOAT else held


def filtered(value: Column, kind: ColumnType, aggregator: Aggregator, test: CompareExpression | None = None, sentinel: str = "reference") -> Column:
    """The aggregate over the values that pass; ``sentinel`` is "reference" or "null" for groups where none does.

    AVG is a double; MAX keeps the column's type and passes over NaN where there is any other value. Both
    are partial aggregates without any state but a number or two, and stay in generated code.
    """
    if sentinel not in ("reference", "null"):
        raise ValueError(f"sentinel is reference or null, not {sentinel!r}")
    taken = F.when(passes(value, kind, test), value) if test else value
    if aggregator is Aggregator.AVG:
        out, none = F.avg(taken), ColumnType.DOUBLE_FLOAT.no_value
    elif kind is ColumnType.DOUBLE_FLOAT:
        out, none = F.coalesce(F.max(F.when(~F.isnan(taken), taken)), F.max(taken)), kind.no_value
    else:
        out, none = F.max(taken), kind.no_value
    return out if sentinel == "null" else F.coalesce(out, F.lit(none).cast("int" if isinstance(none, int) else "double"))
