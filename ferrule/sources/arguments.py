"""Calls and declarations with their arguments, cut at the commas that no bracket and no quote encloses."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A string up to its quote or the end of its line; an opening bracket with the name before it; another bracket, or a comma.
_SIGN = re.compile(r"\"[^\"\n]*\"?|'[^'\n]*'?|(?:(?<![\w:&])([A-Za-z_][\w:]*)[ \t]{0,20})?\(|[\[\]{}),]")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: What stands before the name where a bracket declares a unit's parameters.
_DECLARING = re.compile(r"[ \t]*(?:(?:user|static|main)[ \t]+)?(?:function|method|wsmethod(?:[ \t]+(?:get|post|put|delete|patch))?)[ \t]+", re.I)
_FOUND = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("declares", T.BooleanType())]))


def bracketed(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """(offset, name before the bracket, arguments) of every round bracket that closes, outer ones after those in them.

    One walk with a stack of what is open. Strings are jumped over; a closing sign that fits nothing open is ignored, and one
    that fits an outer bracket closes those in it too. An empty bracket has no argument; ``(a,)`` has two.
    """
    open_: list[tuple[str, int, str, list[int]]] = []
    for m in _SIGN.finditer(text):
        sign = m[0][-1]
        if m[0][0] in "\"'":
            continue
        if sign in _CLOSES:
            open_.append((_CLOSES[sign], m.start(), m[1] or "", [m.end()]))
        elif sign == ",":
            if open_:
                open_[-1][3].append(m.start() + 1)
        elif any(o[0] == sign for o in open_):
            while open_[-1][0] != sign:
                open_.pop()
            _, at, name, cuts = open_.pop()
            if sign == ")":
                args = [text[a : b - 1].strip() for a, b in zip(cuts, [*cuts[1:], m.start() + 1])]
                yield at, name, [] if args == [""] else args


def cut(text: str | None) -> list[str]:
    """The parts of an argument list; none for an empty or missing one."""
    return next((args for at, _, args in bracketed(f"({text or ''})") if at == 0), [])


def calls_in(text: str | None, names: frozenset[str] | None, declared: bool = False) -> list[dict] | None:
    """Calls of the named functions (in lower case), or declarations, in the order of their brackets; null for a null text."""
    if text is None:
        return None
    ends, out = [m.start() for m in re.finditer("\n", text)], []
    for at, name, args in bracketed(text):
        if not name or (names is not None and name.lower() not in names):
            continue
        line = bisect_right(ends, at - 1)
        begin = ends[line - 1] + 1 if line else 0
        if declared is (_DECLARING.fullmatch(text[begin:at]) is not None):
            out.append((at, {"line": line + 1, "name": name, "args": args, "declares": declared}))
    return [x for _, x in sorted(out, key=lambda x: x[0])]


def holding(files: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Files whose text holds one of the names before a bracket, or any bracket."""
    return files.where(F.col("text").rlike("(?i)(" + "|".join(re.escape(n) for n in names) + r")[ \t]*\(") if names is not None else F.col("text").contains("("))


def _exploded(files: DataFrame, key: str, names: Sequence[str] | None, declared: bool) -> DataFrame:
    from ferrule.sources.code import bare_text

    wanted = None if names is None else frozenset(n.lower() for n in names)
    find = F.pandas_udf(lambda s: pd.Series([calls_in(t, wanted, declared) for t in s]), _FOUND)
    found = holding(files, names).select(key, F.explode(find(bare_text(files))).alias("c"))
    return found.select(key, "c.line", "c.name", "c.args")


def call_arguments(files: DataFrame, names: Sequence[str] | None = None, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, line, name, args): calls of the named functions, whatever their case, or of all.

    Comments don't count, nor do declarations and brackets inside strings. A call may go over lines; its line is that of its
    name. Calls inside arguments are rows too. A bracket that never closes gives none; null texts give none.
    """
    return _exploded(files, key, names, False)


def signatures(files: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, line, name, args): the parameters of declared functions and methods, defaults included."""
    return _exploded(files, key, None, True)


def in_unit(facts: DataFrame, units: DataFrame, key: str = "path") -> DataFrame:
    """Rows with a key and a line, and the unit they stand in: the last one declared before or at the line, null before the first.

    One pass over both in order of lines; a declaration comes before what else stands on its line.
    """
    marks = units.select(key, "line", F.col("name").alias("unit"), F.lit(0).alias("_fact"))
    both = facts.withColumns({"unit": F.lit(None).cast("string"), "_fact": F.lit(1)}).unionByName(marks, True)
    own = F.last("unit", ignorenulls=True).over(Window.partitionBy(key).orderBy("line", "_fact").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("unit", own).where("_fact = 1").drop("_fact")


def literal(arg: Column) -> Column:
    """What stands between the quotes of an argument that is one string; empty for anything else."""
    text = F.trim(arg)
    one = text.rlike(r"^\"[^\"]*\"$|^'[^']*'$")
    return F.when(one, text.substr(F.lit(2), F.char_length(text) - 2)).otherwise("")


def argument(args: Column, place: int) -> Column:
    """The argument at a place from 0; empty where the call has fewer."""
    return F.coalesce(F.get(args, F.lit(place)), F.lit(""))
