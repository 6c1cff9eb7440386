"""Comparisons of decision points, evaluated on records as columns."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"=": operator.eq, "==": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_COMPARISON = r"([A-Za-z_][A-Za-z0-9_>-]*) *(==|<>|!=|<=|>=|=|<|>) *(\"[^\"]*\"|'[^']*'|-?[0-9]+(?:[.][0-9]+)?|[A-Za-z_.][A-Za-z0-9_.>-]*)"


def comparisons(lines: DataFrame, text: str = "text") -> DataFrame:
    """Comparisons of if, elseif, while and case lines: the line's columns, left, op, right, operand kind."""
    cond = F.col(text).rlike(r"(?i)^\s*(if|elseif|while|do while|case)\b")
    hits = F.regexp_extract_all(F.col(text), F.lit(_COMPARISON), F.lit(0))
    part = lambda k: F.regexp_extract("hit", _COMPARISON, k)
    right = F.col("right")
    kind = F.when(right.rlike(r"^[\"']"), "text").when(right.rlike(r"^-?[0-9]"), "number").when(right.rlike(r"(?i)^\.[tf]\.$"), "logical").otherwise("name")
    return lines.where(cond).select("*", F.explode(hits).alias("hit")).select(*lines.columns, part(1).alias("left"), part(2).alias("op"), part(3).alias("right")).withColumn("kind", kind)


def condition(column: str, op: str, value) -> Column:
    if op not in _OPS:
        raise ValueError(f"comparison {op!r}")
    return _OPS[op](F.col(column), F.lit(value))


def evaluate(records: DataFrame, terms: list[tuple[str, str, object]]) -> DataFrame:
    """``records`` with ``taken``: whether all terms hold, and ``decided_by``: the first that doesn't."""
    conds = [condition(*t) for t in terms]
    failed = F.lit(None).cast("string")
    for (c, op, v), cond in reversed(list(zip(terms, conds))):
        failed = F.when(~F.coalesce(cond, F.lit(False)), F.lit(f"{c} {op} {v}")).otherwise(failed)
    return records.withColumns({"taken": F.coalesce(reduce(operator.and_, conds), F.lit(False)), "decided_by": failed})


def parse_filter(text: str) -> Column:
    """A filter of comparisons joined by AND only, or by OR only, as a column of string fields.

    Numbers compare as numbers where both sides parse; ``like`` strips % and matches regardless of case. The text is parsed
    to columns, never put into SQL. Anything else is an error.
    """
    sep = "and" if re.search(r"\band\b", text, re.I) else "or"
    conds = []
    for term in re.split(rf"\s+{sep}\s+", text.strip(), flags=re.I):
        m = re.fullmatch(r"\s*(\w+)\s*(==|<>|!=|<=|>=|=|<|>|like)\s*('[^']*'|\"[^\"]*\"|\S+)\s*", term, re.I)
        if not m:
            raise ValueError(f"filter term {term!r}")
        col, op, value = F.col(m[1]).cast("string"), m[2].lower(), m[3].strip("'\"")
        if op == "like":
            conds.append(F.lower(col).contains(value.replace("%", "").lower()))
            continue
        number = col.try_cast("double")
        try:
            as_number = _OPS[op](number, F.lit(float(value)))
        except ValueError:
            conds.append(_OPS[op](col, F.lit(value)))
            continue
        conds.append(F.when(number.isNotNull(), as_number).otherwise(_OPS[op](col, F.lit(value))))
    return reduce(operator.and_ if sep == "and" else operator.or_, conds)
