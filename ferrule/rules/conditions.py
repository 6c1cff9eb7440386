"""Conditions as data: a column of condition texts, read to steps once, evaluated on records with three truth values.

Reading a text is the only part in Python. Its result is a list of steps in postfix order; a fold over the steps with a stack of
values evaluates it, so a table of conditions meets a table of records as columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.text import amount_class

#: How an outcome is said.
OUTCOMES = {".T.": "VERDADEIRO", ".F.": "FALSO", None: "(nao avaliavel)"}
ORDERED = ("<", "<=", ">", ">=")
_SIGN = re.compile(r"\s*(?:(\.and\.|\.or\.|\.not\.|!(?!=))|(==|!=|<>|>=|<=|[=<>$])|([-+*/])|([()])|(\"[^\"]*\"|'[^']*')|(\d+(?:\.\d+)?)|(\.[tf]\.|\bnil\b)|((?:\w+\s*->\s*)?[A-Za-z_][\w:]*))", re.I)
_PARAMETER = re.compile(r"(?:Super)?GetMV\s*\(\s*[\"'](MV_\w+)[\"']", re.I)
_NAMES = ("what", "op", "value", "left", "right", "left_kind", "right_kind")
STEPS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _NAMES]))


class _Reader:
    """A condition read by descent; each level leaves its steps and returns (text, kind) of what it has read."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.steps = text, 0, []
        self.next()

    def next(self) -> None:
        m = _SIGN.match(self.text, self.at)
        if m is None and self.text[self.at :].strip():
            raise ValueError(self.text)
        self.kind, self.sign = (m.lastindex, m[m.lastindex]) if m else (0, "")
        self.begin, self.at = (m.start(m.lastindex), m.end()) if m else (len(self.text), len(self.text))

    def step(self, what: str, **more: str) -> None:
        self.steps.append({**dict.fromkeys(_NAMES), "what": what, **more})

    def either(self, ops: tuple[str, ...], kind: int, level: Callable[[], tuple[str, str]], truths: bool) -> tuple[str, str]:
        begin, (text, of) = self.begin, level()
        while self.kind == kind and self.sign.lower() in ops:
            op = self.sign.lower()
            if truths:
                self.truth(of)
            self.next()
            other = level()[1]
            if truths:
                self.truth(other)
            self.step("logic" if truths else "number", op=op.strip("."))
            text, of = self.text[begin : self.end].strip(), "logic" if truths else "expr"
        return text, of

    def truth(self, kind: str) -> None:
        if kind != "logic":
            self.step("truth")

    def whole(self) -> list[dict]:
        self.truth(self.any()[1])
        if self.kind:
            raise ValueError(self.text)
        return self.steps

    def any(self) -> tuple[str, str]:
        return self.either((".or.",), 1, self.all, True)

    def all(self) -> tuple[str, str]:
        return self.either((".and.",), 1, self.negated, True)

    def negated(self) -> tuple[str, str]:
        if self.kind == 1 and self.sign.lower() in (".not.", "!"):
            begin = self.begin
            self.next()
            self.truth(self.negated()[1])
            self.step("not")
            return self.text[begin : self.end], "logic"
        left, kind = self.sum()
        if self.kind != 2:
            return left, kind
        op = self.sign
        self.next()
        right, other = self.sum()
        self.step("compare", op=op, left=left, right=right, left_kind=kind, right_kind=other)
        return left, "logic"

    def sum(self) -> tuple[str, str]:
        return self.either(("+", "-"), 3, self.product, False)

    def product(self) -> tuple[str, str]:
        return self.either(("*", "/"), 3, self.operand, False)

    def operand(self) -> tuple[str, str]:
        kind, sign, begin = self.kind, self.sign, self.begin
        if kind == 3 and sign == "-":
            self.step("value", value="0")
            self.next()
            self.operand()
            self.step("number", op="-")
            return self.text[begin : self.end], "expr"
        if kind == 4 and sign == "(":
            self.next()
            text, of = self.any()
            if self.sign != ")":
                raise ValueError(self.text)
            self.close()
            return (text, of) if of != "expr" else (self.text[begin : self.end], of)
        if kind not in (5, 6, 7, 8):
            raise ValueError(self.text)
        self.close()
        if kind == 8 and self.sign == "(":
            return self.call(begin)
        name = re.sub(r"^\w+\s*->\s*", "", sign)
        self.step("name" if kind == 8 else "value", value=name.upper() if kind in (7, 8) else sign.strip("\"'"))
        return name if kind == 8 else sign, "literal" if kind in (5, 6) else "const" if kind == 7 else "name"

    def close(self) -> None:
        self.end = self.at
        self.next()

    def call(self, begin: int) -> tuple[str, str]:
        depth = 0
        for m in re.finditer(r"\"[^\"]*\"|'[^']*'|[()]", self.text[self.begin :]):
            depth += (m[0] == "(") - (m[0] == ")")
            if not depth:
                break
        else:
            raise ValueError(self.text)
        self.at = self.begin + m.end()
        self.close()
        text = self.text[begin : self.end]
        named = _PARAMETER.match(text)
        self.step("name", value=named[1].upper() if named else "")
        return text, "call"


def read_condition(text: str | None) -> list[dict] | None:
    """The steps of a condition in postfix order; none at all for a text that is empty or no condition."""
    try:
        return _Reader(re.sub(r"//.*", "", text) if text and "\"" not in text and "'" not in text else text).whole() if text and text.strip() else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(STEPS)
def _read_all(texts: pd.Series) -> pd.Series:
    return texts.map(read_condition)


def record_map(*columns: str) -> Column:
    """The named columns of a row as a record: names in upper case, logical values as .T. and .F., others as text."""
    shown = []
    for c in columns:
        shown += [F.lit(c.upper()), F.col(f"`{c}`").cast("string")]
    return F.transform_values(F.create_map(*shown), lambda k, v: F.when(v == "true", ".T.").when(v == "false", ".F.").otherwise(v))


def _number(value: Column) -> Column:
    """A text as a number; a decimal comma counts with dots as thousands."""
    text = F.trim(value)
    return F.when(text.contains(","), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text).try_cast("double")


def _said(c: Column) -> Column:
    return F.when(c, ".T.").when(~c, ".F.")


def _compared(op: Column, a: Column, b: Column) -> Column:
    x, y = _number(a), _number(b)
    equal = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.trim(a) == F.trim(b))
    ordered = F.when(op == ">", x > y).when(op == "<", x < y).when(op == ">=", x >= y).when(op == "<=", x <= y)
    return F.when(a.isNull() | b.isNull(), None).otherwise(_said(F.when(op.isin("=", "=="), equal).when(op.isin("!=", "<>"), ~equal).when(op == "$", F.contains(F.trim(b), F.trim(a))).otherwise(ordered)))


def _shown(number: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("decimal(18,0)").cast("string")).otherwise(number.cast("string"))


def _arithmetic(op: Column, a: Column, b: Column) -> Column:
    x, y = _number(a), _number(b)
    return _shown(F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when((op == "/") & (y != 0), x / y))


def _explained(s: Column, a: Column, b: Column, outcome: Column, financial: Sequence[str]) -> Column:
    """A comparison in words; amounts by ratio or range only."""
    said = F.lit(OUTCOMES[None])
    for k in (".T.", ".F."):
        said = F.when(outcome == k, OUTCOMES[k]).otherwise(said)
    hidden = rf"(?i)\b({'|'.join(map(str.upper, financial))})\b" if financial else r"(?!)"
    fin = lambda text, kind: kind.isin("name", "expr") & F.upper(text).rlike(hidden)
    x, y = _number(a), _number(b)
    left, right = s["left"], s["right"]

    def side(text: Column, kind: Column, value: Column) -> Column:
        bare = F.regexp_replace(text, "^[\"']|[\"']$", "")
        return F.when(kind == "literal", bare).when(value.isNull(), text).when(fin(text, kind) & _number(value).isNotNull(), F.concat(text, F.lit("(~"), amount_class(_number(value)), F.lit(")"))).otherwise(F.concat(text, F.lit("="), F.trim(value)))

    ratio = F.when(y != 0, F.concat(left, F.lit(" ~"), F.bround(x / y * 100).cast("long").cast("string"), F.lit("% de "), right)).otherwise(F.concat(left, F.lit(" "), s["op"], F.lit(" "), right, F.lit("(zero)")))
    related = s["op"].isin(*ORDERED) & x.isNotNull() & y.isNotNull() & (fin(left, s["left_kind"]) | fin(right, s["right_kind"]))
    plain = F.concat(side(left, s["left_kind"], a), F.lit(" "), s["op"], F.lit(" "), side(right, s["right_kind"], b))
    return F.concat(F.when(related, ratio).otherwise(plain), F.lit(" -> "), said)


def judged(rows: DataFrame, condition: str = "condition", record: str = "record", financial: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``outcome`` (true, false, null: not to be told) and ``explained``: a sentence for each comparison, in order.

    ``condition`` holds texts, ``record`` maps of names in upper case to values as text (``record_map``). Comparisons are by
    number where both sides are numbers, else by text without outer blanks; order is for numbers only; ``$`` is containment.
    Names without a value, calls other than parameter reads, and what can't be read are null; .And. is false with one false
    side, .Or. true with one true side, whatever the other. Amounts among ``financial`` names are only shown as ratios or
    ranges. A null condition or record gives a null outcome.
    """
    steps = rows.withColumn("_steps", _read_all(F.col(condition)))

    def fold(acc: Column, s: Column) -> Column:
        stack = acc["stack"]
        n = F.size(stack)
        b = F.when(n > 0, F.get(stack, n - 1))
        a = F.when(n > 1, F.get(stack, n - 2))
        what, op = s["what"], s["op"]
        both = F.when((op == "and") & ((a == ".F.") | (b == ".F.")), ".F.").when((op == "or") & ((a == ".T.") | (b == ".T.")), ".T.").when(a.isNull() | b.isNull(), None).otherwise(b)
        truth = F.when(b.isin(".T.", ".F."), b)
        outcome = _compared(op, a, b)
        found = F.try_element_at(F.col(record), s["value"])
        pushed = F.when(what == "value", s["value"]).when(what == "name", found).when(what == "number", _arithmetic(op, a, b)).when(what == "compare", outcome).when(what == "truth", truth)
        pushed = pushed.when(what == "not", F.when(b == ".T.", ".F.").when(b == ".F.", ".T.")).when(what == "logic", both)
        taken = F.when(what.isin("value", "name"), 0).when(what.isin("truth", "not"), 1).otherwise(2)
        kept = F.slice(stack, F.lit(1), F.greatest(n - taken, F.lit(0)))
        told = F.when(what == "compare", F.array(_explained(s, a, b, outcome, financial))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(kept, F.array(pushed)).alias("stack"), F.concat(acc["told"], told).alias("told"))

    none = F.array().cast("array<string>")
    done = F.aggregate(F.when(F.col(record).isNotNull(), F.col("_steps")), F.struct(none.alias("stack"), none.alias("told")), fold)
    last = F.get(done["stack"], F.lit(0))
    return steps.withColumn("_done", F.struct(done["told"].alias("told"), last.alias("last"))).select(*rows.columns, F.when(F.col("_done.last") == ".T.", True).when(F.col("_done.last") == ".F.", False).alias("outcome"), F.col("_done.told").alias("explained"))
