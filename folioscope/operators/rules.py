"""Rule trees over a row's fields, folded into one boolean column.

Two-valued: a condition whose field is null is false for every operator, also
the negative ones, and a NOT around it is true.  The columns stay visible to
the optimizer, so rules over scan columns are pushed down.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("==", "is", "!=", "not is", ">", "<", ">=", "<=", "in", "not in")


def condition(field: Column, operator: str, value: Any) -> Column:
    """One comparison; ``value`` is a plain value, a list, or a column."""
    op = operator.lower()
    if op not in OPERATORS:
        raise ValueError(f"unsupported operator: {operator}")
    other = isinstance(value, Column)
    right = value if other else F.lit(value) if not isinstance(value, list | tuple) else None
    if op in ("in", "not in"):
        inside = field.isin(*value) if right is None else F.contains(right, field.cast("string"))
        test = F.coalesce(inside, F.lit(False))
        test = ~test if op == "not in" else test
    elif op in ("==", "is", "!=", "not is"):
        test = field.eqNullSafe(right) if right is not None else F.lit(False)
        test = ~test if op in ("!=", "not is") else test
    else:
        test = {">": field.__gt__, "<": field.__lt__, ">=": field.__ge__, "<=": field.__le__}[op](right)
        test = F.coalesce(test, F.lit(False))
    return F.coalesce(field.isNotNull() & test, F.lit(False))


def rule(tree: dict[str, Any], columns: list[str]) -> Column:
    """A tree of ``condition``, ``and``, ``or`` and ``not`` nodes; a text value ``ctx:x`` is column ``x``, an unknown field is null."""
    kind = tree["op"]
    if kind == "condition":
        named = lambda x: F.col(x) if x in columns else F.lit(None)
        value = tree["value"]
        if isinstance(value, str) and value.startswith("ctx:"):
            value = named(value[4:])
        return condition(named(tree["field"]), tree["operator"], value)
    if kind == "not":
        return ~rule(tree["rule"], columns)
    parts = [rule(x, columns) for x in tree["rules"]]
    if kind not in ("and", "or") or not parts:
        raise ValueError(f"not a rule: {kind}")
    return reduce(lambda a, b: a & b if kind == "and" else a | b, parts)


def rule_filter(df: DataFrame, tree: dict[str, Any]) -> DataFrame:
    return df.filter(rule(tree, df.columns))
