"""Column expressions on text: matching, snippets, redaction, normalisation. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in the order in which findings are listed.
SEVERITIES = ("critical", "error", "warning", "info")
LOG_SEVERITIES = ("critical", "warning")


def contains_ci(col: Column, needle: str) -> Column:
    """Substring, regardless of case."""
    return F.lower(col).contains(needle.lower())


def word_match(col: Column, word: str) -> Column:
    """``word`` as a whole identifier, regardless of case: not inside a longer one."""
    return col.rlike(rf"(?i)(^|[^A-Za-z0-9_]){re.escape(word)}([^A-Za-z0-9_]|$)")


def whole_words(words: Sequence[str]) -> str:
    """A pattern for words in a row, each whole, in a text in lower case. It begins with a letter of its own, so that a scan is fast."""
    first, *more = words
    return rf"{first}(?<![a-z0-9_]{first})" + "".join(f"[^a-z0-9_]+{w}" for w in more) + "(?![a-z0-9_])"


def word_position(col: Column, word: str) -> Column:
    """1-based position of the first whole-identifier match, 0 for none. Only what stands before the match is read for it."""
    if re.fullmatch("[a-z0-9_]+", word.lower()):
        low, whole = F.lower(col), whole_words([word.lower()])
        return F.when(low.rlike(whole), F.char_length(F.regexp_extract(low, "(?s)^(.*?)" + whole, 1)) + 1).otherwise(F.lit(0))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(col), r"[^a-z0-9_]", " "), F.lit(" "))
    return F.instr(spaced, f" {word.lower()} ")


def snippet(col: Column, position: Column, before: int = 30, length: int = 200) -> Column:
    """Text around a 1-based position, from ``before`` characters ahead of it."""
    return F.substring(col, F.greatest(F.lit(1), position - before), F.lit(length))


def collapse(col: Column, length: int = 200) -> Column:
    """White space runs as one space, cut to ``length``."""
    return F.substring(F.trim(F.regexp_replace(col, r"[ \t\r\n]+", " ")), 1, length)


def tokens(col: Column) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9_]+", " "), " "), lambda w: w != ""))


def glob_regex(pattern: str) -> str:
    """File glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't; a final / means all below."""
    out, k = "", 0
    pattern = pattern + "**" if pattern.endswith("/") else pattern
    while k < len(pattern):
        if pattern[k : k + 2] == "**":
            out, k = out + ".*", k + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k]))
        k += 1
    return f"^{out}$" if "/" in pattern else f"(^|/){out}$"


def severity_rank(col: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    out = F.lit(len(order))
    for k, s in reversed(list(enumerate(order))):
        out = F.when(col == s, k).otherwise(out)
    return out


def strip_user_prefix(col: Column) -> Column:
    """Function name without its user-function prefix, upper case."""
    return F.regexp_replace(F.upper(F.trim(col)), r"^U_", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


#: What counts as a secret, in the order in which it is replaced; safe in Java and RE2.
SECRETS = (
    (r"(?i)(bearer )[A-Za-z0-9._~+/-]{16,}=*", "$1<secret>"),
    (r"(?i)((?:password|passwd|senha|token|api_?key|secret)[ ]*[=:][ ]*)[^\s,;]+", "$1<secret>"),
    (r"([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s:@]+@", "$1<secret>@"),
    (r"\b[0-9a-fA-F]{40,}\b", "<hex>"),
)


#: Secrets of compiler output and of masked results, in the order in which they are replaced. Names keep standing; a number alone is no key.
CONFIG_SECRETS = (
    (r"(?i)(password)\s*[:=]+\s*\S+", "$1=***REDACTED***"),
    (r"(?i)(psw)\s*[:=]+\s*\S+", "$1=***REDACTED***"),
    (r"(?i)(senha)\s*[:=]+\s*\S+", "$1=***REDACTED***"),
    (r"(?i)(pwd)\s*[:=]+\s*\S+", "$1=***REDACTED***"),
    (r"\b(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{16,}\b", "***HEX_REDACTED***"),
    (r"(?i)(aut_file|authorization)\s*[:=]+\s*\S+", "$1=***REDACTED***"),
    (r"(?i)([a-z][a-z0-9+.-]*://)[^:\s/@]+:[^@\s]+@", "$1[REDACTED]@"),
)


def redact(col: Column, patterns=SECRETS) -> Column:
    """Secrets replaced one pattern after the other."""
    for p, to in patterns:
        col = F.regexp_replace(col, p, to)
    return col


#: Phrases that try to steer a reader of the text.
INJECTIONS = {
    "ignore": r"(?i)ignore (all |any )?(previous|prior|above) (instructions|prompts)",
    "role": r"(?i)you are now [a-z]+",
    "system": r"(?i)(^|\n)\s*(system|assistant) ?:",
    "reveal": r"(?i)(reveal|print|show) (the |your )?(system )?prompt",
    "tag": r"(?i)</?(system|instructions?)>",
    "disregard": r"(?i)disregard (the )?(rules|instructions)",
    "act": r"(?i)act as (an? )?[a-z]+",
    "jailbreak": r"(?i)jailbreak|developer mode",
}


def injection_hits(col: Column, patterns: dict[str, str] = INJECTIONS) -> Column:
    """Names of the patterns that a text holds."""
    return F.array_compact(F.array(*[F.when(col.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def hmac_sha256(col: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text's UTF-8, in hex."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(col, "UTF-8")), 256))), 256)


#: Limits of the amount classes and their names.
AMOUNTS = ((1e3, "<1k"), (1e4, "1k-10k"), (1e5, "10k-100k"), (1e6, "100k-1M"), (1e7, "1M-10M"), (1e8, "10M-100M"))


def amount_class(col: Column) -> Column:
    """Range of an amount with its sign; null stays null."""
    size = F.abs(col)
    name = F.lit(">=100M")
    for limit, label in reversed(AMOUNTS):
        name = F.when(size < limit, label).otherwise(name)
    return F.when(col.isNotNull(), F.concat(F.when(col < 0, "-").otherwise(""), name))


def check_digits(digits: Column, weights: list[list[int]]) -> Column:
    """Whether the last digits are the modulo-11 check digits of those before: one list of weights for each."""
    d = F.transform(F.split(digits, ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    good = F.lit(True)
    for w in weights:
        total = F.aggregate(F.zip_with(F.slice(d, 1, len(w)), F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0), lambda a, b: a + b)
        want = F.when(total % 11 < 2, 0).otherwise(11 - total % 11)
        good &= F.element_at(d, len(w) + 1) == want
    return good & ~digits.rlike(r"^(\d)\1*$")


CPF_WEIGHTS = [list(range(10, 1, -1)), list(range(11, 1, -1))]
CNPJ_WEIGHTS = [[5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]]


def version_key(col: Column) -> Column:
    """Dotted version as an array of numbers, for comparison; parts that aren't numbers count as 0."""
    return F.transform(F.split(col, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def padded_version(col: Column, places: int = 8) -> Column:
    """``version_key`` with zeros to a fixed length, so that versions of unequal length compare."""
    digits = F.transform(F.split(col, r"\."), lambda p: F.coalesce(F.regexp_extract(F.trim(p), r"^(\d+)", 1).try_cast("long"), F.lit(0)))
    return F.slice(F.concat(digits, F.array_repeat(F.lit(0).cast("long"), places)), 1, places)
