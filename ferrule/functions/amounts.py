"""Amounts as named ranges, and which columns hold amounts."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import amount_class

#: Beginnings of the last part of a column's name, and words anywhere in it, that tell of money.
MONEY_PREFIXES = ("VL", "VAL", "SAL", "PRC", "PRV", "PRU")
MONEY_WORDS = (
    "SALDO SALDU LIMITE _LC CUST UNIT UPRC VATU MERC TOTAL COMIS FRETE DESCON DESCNT JUR IRRF INSS FECP ICMS COFINS TRIBUT MULTA SEGURO RENDA SALARIO MONTAN DEBITO CREDITO ADIANT ANTECIP "
    "LIQUID BRUTO PRECO DESP BASE"
).split()
#: Digits before the point from which a number without groups is a volume.
VOLUME_DIGITS = 4


def is_money(name: str, known: Collection[str] = ()) -> bool:
    """Whether a column holds money: it is known to (regardless of case), or its name says so."""
    upper = name.upper()
    return upper in known or upper.rsplit("_", 1)[-1].startswith(MONEY_PREFIXES) or any(w in upper for w in MONEY_WORDS)


def amount(col: Column) -> Column:
    """A number from a number or a text, also as ``1.234,56``: where both signs stand the point groups, a comma alone is decimal. Null for other texts."""
    text = F.replace(F.trim(col.cast("string")), F.lit(" "), F.lit(""))
    comma = text.contains(",")
    plain = F.when(comma, F.replace(F.when(text.contains("."), F.replace(text, F.lit("."), F.lit(""))).otherwise(text), F.lit(","), F.lit("."))).otherwise(text)
    return plain.try_cast("double")


def amount_range(col: Column) -> Column:
    """``~`` with sign and range of an amount, ``~0`` for nothing; null for what is no amount."""
    value = amount(col)
    return F.when(value == 0, "~0").otherwise(F.concat(F.lit("~"), amount_class(value)))


def picture_class(picture: Column) -> Column:
    """What an edit picture shows: ``money`` if it groups digits, ``volume`` if it is long, else ``rate``."""
    whole = F.split_part(picture, F.lit("."), F.lit(1))
    return F.when(picture.contains(","), "money").when(F.length(F.regexp_replace(whole, "[^9]", "")) >= VOLUME_DIGITS, "volume").otherwise("rate")


def money_fields(fields: DataFrame, classes: Collection[str] | None = None) -> DataFrame:
    """(field) of dictionary fields that are numbers with decimals, of the given picture classes or of all.

    fields: (field, type, decimals, picture). Nulls count as empty; decimals that are no number as 0. A dictionary is small: its
    names are what ``Masking.money`` takes.
    """
    name = F.upper(F.trim(F.coalesce("field", F.lit(""))))
    number = (F.upper(F.trim("type")) == "N") & (F.coalesce(F.trim(F.col("decimals").cast("string")).try_cast("int"), F.lit(0)) > 0)
    own = fields.where(number & (name != ""))
    if classes is not None:
        own = own.where(picture_class(F.coalesce("picture", F.lit(""))).isin(*[c.lower() for c in classes]))
    return own.select(name.alias("field")).distinct()
