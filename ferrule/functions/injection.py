"""Texts that try to steer a reader: which rules they meet, and a mark before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands before a marked text, and how much of a match is shown.
MARKER, SHOWN = "[!INJECAO?] ", 60
#: Rules by name, in order. Words of any script, dots don't cross lines.
RULES = (
    ("ignore-instrucoes", r"\b(ignore|disregard|esque[çc]a|desconsidere|forget)\b.{0,30}\b(previous|prior|above|todas?\s+as|anteriores?|acima|instru\w*|prompt)"),
    ("troca-papel", r"\b(you\s+are\s+now|act\s+as|aja\s+como|finja\s+(ser|que)|pretend\s+to\s+be|from\s+now\s+on|de\s+agora\s+em\s+diante)\b"),
    ("system-prompt", r"(system\s*(prompt|message|role)|</?\s*system\s*>|prompt\s+do\s+sistema|mensagem\s+do\s+sistema)"),
    ("endereca-ia", r"\b(assistant|assistente|chatgpt|copilot|language\s+model|modelo\s+de\s+linguagem)\s*[:,]"),
    ("jailbreak", r"\b(jailbreak|dan\s+mode|developer\s+mode|do\s+anything\s+now)\b"),
    ("burla-regra", r"\b(override|bypass|ignore|burl[ae])\b.{0,20}\b(your\s+)?(rules?|guard\w*|safety|restri\w*|regras?|prote[çc]\w*|filtros?)"),
    ("exfiltracao", r"(exfiltrat\w*|\b(post|send|envie|leak|vaze|poste|upload)\b.{0,30}\b(dados|data|creden\w*|secret\w*|senhas?|tokens?|\.env|chaves?|password\w*)\b.{0,30}https?://)"),
    ("marcador-instrucao", r"(###\s*instruction|<\s*instruction|nota\s+para\s+(a\s+)?(ia|ai)\b|instru[çc][ãa]o\s+para\s+(a\s+)?(ia|ai)\b|important\s*:\s*(ai|llm|assistant))"),
)


def scan(text: Column) -> Column:
    """(rule, snippet) of every rule that a text meets, in order; empty for null and empty texts."""
    hits = [F.when(text.rlike(f"(?iUd){p}"), F.struct(F.lit(n).alias("rule"), F.substring(F.regexp_extract(text, f"(?iUd){p}", 0), 1, SHOWN).alias("snippet"))) for n, p in RULES]
    return F.array_compact(F.array(*hits))


def flagged(df: DataFrame, columns: Sequence[str] | None = None, hits: str = "hits") -> DataFrame:
    """Rows whose texts that meet a rule begin with ``MARKER``, and a column of all (column, rule, snippet) of the row.

    Texts are the string columns, or the named ones; nothing else changes. Nulls stay null.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and (columns is None or f.name in columns)]
    col = lambda n: F.col(f"`{n}`")
    of = lambda n: lambda h: F.struct(F.lit(n).alias("column"), h["rule"].alias("rule"), h["snippet"].alias("snippet"))
    found = [F.transform(scan(col(n)), of(n)) for n in names]
    none = F.array().cast("array<struct<column:string,rule:string,snippet:string>>")
    marked = {n: F.when(F.size(scan(col(n))) > 0, F.concat(F.lit(MARKER), col(n))).otherwise(col(n)) for n in names}
    return df.withColumns({hits: F.concat(none, *found), **marked})
