"""Recognisers and maskers of personal identifiers, as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType, StructType

from ferrule.functions.amounts import amount_range, is_money
from ferrule.functions.text import CNPJ_WEIGHTS, CPF_WEIGHTS, SECRETS, amount_class, check_digits, hmac_sha256, redact

#: Shapes of the identifiers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
CPF = r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b"
CNPJ = r"\b[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}\b"


def emails(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(EMAIL), F.lit(0))


def ipv4(col: Column) -> Column:
    """IPv4 addresses whose octets are at most 255."""
    return F.filter(F.regexp_extract_all(col, F.lit(IPV4), F.lit(0)), lambda a: F.forall(F.split(a, r"\."), lambda o: o.cast("int") <= 255))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def cpfs(col: Column) -> Column:
    """Person numbers with valid check digits."""
    return F.filter(F.regexp_extract_all(col, F.lit(CPF), F.lit(0)), lambda x: (F.length(_digits(x)) == 11) & check_digits(_digits(x), CPF_WEIGHTS))


def cnpjs(col: Column) -> Column:
    """Company numbers with valid check digits."""
    return F.filter(F.regexp_extract_all(col, F.lit(CNPJ), F.lit(0)), lambda x: (F.length(_digits(x)) == 14) & check_digits(_digits(x), CNPJ_WEIGHTS))


#: Recognisers by label, in the order in which they are replaced.
RECOGNISERS = {"CNPJ": cnpjs, "CPF": cpfs, "EMAIL": emails, "IP": ipv4}


#: The digits of base 32, and how many of them a token has.
BASE32, TOKEN_LENGTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 10
#: Ways to replace an identifier: ``hex`` and ``label`` name its kind, ``fpe`` keeps the layout of numbers with check digits.
STYLES = ("hex", "label", "fpe")
_CHECKED = {"CPF": CPF_WEIGHTS, "CNPJ": CNPJ_WEIGHTS}


def normalised(value: Column, label: str) -> Column:
    """What a token is made from: the digits of a number, else the text without outer blanks, in lower case."""
    return _digits(value) if label in _CHECKED else F.lower(F.trim(value))


def label_token(value: Column, label: str, key: bytes) -> Column:
    """``KIND_`` and ten base-32 digits of the keyed hash of the normalised value, however it is written."""
    bits = F.shiftright(F.conv(F.substring(hmac_sha256(normalised(value, label), key), 1, 13), 16, 10).cast("long"), 2)
    digit = lambda n, k: F.substr(F.lit(BASE32), F.shiftright(n, 5 * (TOKEN_LENGTH - 1 - k)).bitwiseAND(31).cast("int") + 1, F.lit(1))
    code = F.get(F.transform(F.array(bits), lambda n: F.concat(*[digit(n, k) for k in range(TOKEN_LENGTH)])), F.lit(0))
    return F.concat(F.lit(f"{label}_"), code)


def _with_check_digit(weights: list[int]) -> Callable[[Column], Column]:
    """Digits with the modulo-11 check digit of the first ones behind them."""

    def extended(d: Column) -> Column:
        left = F.aggregate(F.zip_with(d, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda a, b: a + b) % 11
        return F.concat(d, F.array(F.when(left < 2, 0).otherwise(11 - left)))

    return extended


def layout_token(value: Column, label: str, key: bytes) -> Column:
    """A number with valid check digits from the keyed hash of its digits, in the layout of ``value``."""
    seed = F.concat(F.lit("fpe:"), _digits(value))
    weights = _CHECKED[label]
    free = len(weights[0])
    # each step reads the array before it once, so it is bound to a name by transform
    base = F.transform(F.array(hmac_sha256(seed, key)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(free - 1)), lambda k: F.conv(h.substr(2 * k + 1, F.lit(2)), 16, 10).cast("int") % 10))
    for w in weights:
        base = F.transform(base, _with_check_digit(w))
    # the digits of the layout are taken one after the other
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    is_digit = lambda c: c.rlike("^[0-9]$")
    step = lambda d: lambda a, c: F.struct(F.concat(a["out"], F.when(is_digit(c), F.get(d, a["n"]).cast("string")).otherwise(c)).alias("out"), (a["n"] + is_digit(c).cast("int")).alias("n"))
    return F.get(F.transform(base, lambda d: F.aggregate(signs, start, step(d))["out"]), F.lit(0))


def token_of(value: Column, label: str, key: bytes, style: str) -> Column:
    """The token of a value in one of ``STYLES``; ``fpe`` gives labels to what has no check digits."""
    if style == "hex":
        return F.concat(F.lit(f"<{label}_"), F.substring(F.upper(hmac_sha256(value, key)), 1, 10), F.lit(">"))
    return layout_token(value, label, key) if style == "fpe" and label in _CHECKED else label_token(value, label, key)


def mask(col: Column, key: bytes, labels: Sequence[str] = tuple(RECOGNISERS), style: str = "hex") -> Column:
    """A text with its identifiers replaced by keyed tokens; equal values get equal tokens."""

    def replaced(text: Column, label: str, values: Column) -> Column:
        token = lambda v: token_of(v, label, key, style)
        return F.aggregate(F.array_distinct(values), text, lambda t, v: F.regexp_replace(t, F.concat(F.lit(r"\b\Q"), v, F.lit(r"\E\b")), token(v)))

    for label, found in RECOGNISERS.items():
        if label in labels:
            col = replaced(col, label, found(col))
    return col


def format_preserving(col: Column, key: bytes) -> Column:
    """A person number in the same layout whose digits come from a keyed hash, with valid check digits."""
    h = hmac_sha256(_digits(col), key)
    base = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.conv(h.substr(2 * k - 1, F.lit(2)), 16, 10).cast("int") % 10)

    def digit(d: Column, start: int) -> Column:
        w = F.sequence(F.lit(start), F.lit(2), F.lit(-1))
        total = F.aggregate(F.zip_with(d, w, lambda a, b: a * b), F.lit(0), lambda a, b: a + b)
        return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)

    nine = F.concat(base, F.array(digit(base, 10)))
    digits = F.array_join(F.transform(F.concat(nine, F.array(digit(nine, 11))), lambda x: x.cast("string")), "")
    dotted = F.concat(digits.substr(1, 3), F.lit("."), digits.substr(4, 3), F.lit("."), digits.substr(7, 3), F.lit("-"), digits.substr(10, 2))
    return F.when(col.contains("."), dotted).otherwise(digits)


@dataclass(frozen=True)
class Masking:
    """Settings of a mask: which identifiers, the key, whether secrets and amounts are hidden too.

    ``amounts`` are columns by name; with ``bucketize`` columns that ``money`` names, or whose own name tells of money, become ranges too.
    """

    key: bytes
    recognisers: tuple[str, ...] = ("CNPJ", "CPF", "EMAIL", "IP")
    secrets: bool = True
    amounts: tuple[str, ...] = ()
    style: str = "hex"
    bucketize: bool = False
    money: frozenset[str] = frozenset()
    patterns: tuple[tuple[str, str], ...] = SECRETS

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"style {self.style!r}")

    @classmethod
    def of(cls, settings: Mapping[str, str]) -> Masking:
        """From named settings, as of a configuration file: key, recognisers, secrets, amounts; lists by comma."""
        names = tuple(x.strip().upper() for x in settings.get("recognisers", "CNPJ,CPF,EMAIL,IP").split(",") if x.strip())
        if unknown := set(names) - set(RECOGNISERS):
            raise ValueError(f"recognisers {sorted(unknown)}")
        if not settings.get("key"):
            raise ValueError("a key is needed")
        return cls(settings["key"].encode(), names, settings.get("secrets", "yes").lower() in ("yes", "true", "1", "on"), tuple(x.strip() for x in settings.get("amounts", "").split(",") if x.strip()), settings.get("style", "hex").lower(), settings.get("bucketize", "no").lower() in ("yes", "true", "1", "on"))

    def apply(self, df: DataFrame, replaced: str | None = None) -> DataFrame:
        """``df`` with its texts masked and the named amount columns as ranges; secrets go before identifiers.

        Texts inside structs, arrays and map values are masked too, at any depth; names of fields, keys of maps and other
        types stay. Nulls stay null, empty arrays empty. With ``replaced``, a column of that name counts what the mask has
        replaced in the row: a struct with a number for each recogniser, and for amounts, worked out in the same pass.
        """
        out, counts = {}, dict.fromkeys((*self.recognisers, *(["AMOUNT"] if self.amounts or self.bucketize else [])), F.lit(0))
        for f in df.schema.fields:
            col = F.col(f"`{f.name}`")
            if f.name in self.amounts:
                out[f.name] = amount_class(col.try_cast("double"))
                counts["AMOUNT"] = counts["AMOUNT"] + col.try_cast("double").isNotNull().cast("int")
                continue
            if self.bucketize and isinstance(f.dataType, (NumericType, StringType)) and is_money(f.name, self.money):
                ranged = amount_range(col)
                rest = mask(self._bare(col), self.key, self.recognisers, self.style) if isinstance(f.dataType, StringType) else F.lit(None)
                out[f.name] = F.coalesce(ranged, rest)
                counts["AMOUNT"] = counts["AMOUNT"] + ranged.isNotNull().cast("int")
                if isinstance(f.dataType, StringType):
                    for label in self.recognisers if replaced else ():
                        counts[label] = counts[label] + F.when(ranged.isNull() & col.isNotNull(), F.size(RECOGNISERS[label](self._before(col, label)))).otherwise(0)
                continue
            if not _holds_text(f.dataType):
                continue
            out[f.name] = _rebuilt(col, f.dataType, lambda c: mask(self._bare(c), self.key, self.recognisers, self.style))
            for label in self.recognisers if replaced else ():
                found = lambda c, label=label: F.size(RECOGNISERS[label](self._before(c, label)))
                counts[label] = counts[label] + _summed(col, f.dataType, found)
        if replaced:
            out[replaced] = F.struct(*[n.alias(k) for k, n in counts.items()])
        return df.withColumns(out)

    def _bare(self, text: Column) -> Column:
        return redact(text, self.patterns) if self.secrets else text

    def _before(self, text: Column, label: str) -> Column:
        """A text as the recogniser of a label meets it: those before it have replaced theirs."""
        earlier = [r for r in RECOGNISERS if r in self.recognisers]
        return mask(self._bare(text), self.key, earlier[: earlier.index(label)], self.style)


def _holds_text(of: DataType) -> bool:
    if isinstance(of, StructType):
        return any(_holds_text(f.dataType) for f in of.fields)
    if isinstance(of, (ArrayType, MapType)):
        return _holds_text(of.elementType if isinstance(of, ArrayType) else of.valueType)
    return isinstance(of, StringType)


def _rebuilt(col: Column, of: DataType, text: Callable[[Column], Column]) -> Column:
    """A column with a function applied to every text in it."""
    if not _holds_text(of):
        return col
    if isinstance(of, StructType):
        return F.when(col.isNotNull(), F.struct(*[_rebuilt(col[f.name], f.dataType, text).alias(f.name) for f in of.fields]))
    if isinstance(of, ArrayType):
        return F.transform(col, lambda c: _rebuilt(c, of.elementType, text))
    if isinstance(of, MapType):
        return F.transform_values(col, lambda _, c: _rebuilt(c, of.valueType, text))
    return text(col)


def _summed(col: Column, of: DataType, number: Callable[[Column], Column]) -> Column:
    """The sum of a number of every text in a column; nulls count as 0."""
    if not _holds_text(of):
        return F.lit(0)
    if isinstance(of, StructType):
        return sum((_summed(col[f.name], f.dataType, number) for f in of.fields), F.lit(0))
    if isinstance(of, MapType):
        col, of = F.map_values(col), ArrayType(of.valueType)
    if isinstance(of, ArrayType):
        return F.coalesce(F.aggregate(col, F.lit(0), lambda n, c: n + _summed(c, of.elementType, number)), F.lit(0))
    return F.when(col.isNotNull(), number(col)).otherwise(0)
