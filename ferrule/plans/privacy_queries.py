"""Tokens, secrets, amounts and injection marks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import amounts, injection
from ferrule.functions.masking import BASE32, Masking, label_token
from ferrule.functions.text import CONFIG_SECRETS, redact
from ferrule.registry import query

_KEY = b"demo-key"
_PAD = {n: bytes(b ^ x for b in _KEY.ljust(64, bytes(1))).hex() for n, x in (("inner", 0x36), ("outer", 0x5C))}


@query(f"""
WITH h AS (SELECT c_custkey, ('0x' || substr(sha256(unhex('{_PAD["outer"]}') || unhex(sha256(unhex('{_PAD["inner"]}') || encode(lower(trim(c_name)))))), 1, 13))::BIGINT >> 2 AS n FROM customer)
SELECT c_custkey, 'EMAIL_' || list_aggregate(list_transform(range(10), lambda i: substr('{BASE32}', ((n >> (45 - 5 * i)::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS token FROM h""")
def label_tokens(t):
    """Tokens in base 32 of the normalised values (PRV-02)."""
    return t.customer.select("c_custkey", label_token(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")), "EMAIL", _KEY).alias("token"))


@query("""
SELECT o_orderkey, CASE WHEN abs(x) = 0 THEN '~0' ELSE '~' || CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN abs(x) < 1000 THEN '<1k' WHEN abs(x) < 10000 THEN '1k-10k' WHEN abs(x) < 100000 THEN '10k-100k' WHEN abs(x) < 1000000 THEN '100k-1M' WHEN abs(x) < 10000000 THEN '1M-10M' WHEN abs(x) < 100000000 THEN '10M-100M' ELSE '>=100M' END END AS total,
  o_orderstatus AS status, 1 AS n FROM (SELECT *, floor(o_totalprice) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS x FROM orders)""")
def money_columns(t):
    """Columns that their name or the dictionary shows as money become ranges, from texts with decimal commas (PRV-06, PRV-08)."""
    whole = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.floor("o_totalprice").cast("long").cast("string"), F.lit(",00"))
    rows = t.orders.select("o_orderkey", whole.alias("total"), F.col("o_orderstatus").alias("status"))
    masked = Masking(_KEY, ("EMAIL",), bucketize=True).apply(rows, "r")
    return masked.select("o_orderkey", "total", "status", F.col("r.AMOUNT").alias("n"))


@query(r"""
WITH s AS (SELECT p_partkey, ['password=***REDACTED*** x', 'psw=***REDACTED***', 'Senha=***REDACTED***', 'pwd=***REDACTED***', 'k ***HEX_REDACTED***', 'authorization=***REDACTED***', 'http://[REDACTED]@h/p', 'n 1234567890123456'][p_partkey % 8 + 1] AS v FROM part)
SELECT p_partkey, p_partkey || ' ' || v AS text FROM s""")
def config_secrets(t):
    """The seven patterns of secrets, each where it stands (PRV-04)."""
    given = ("password := abc x", "psw=1", "Senha: 2", "pwd = 3", "k 0123456789abcdef0", "authorization:: q", "http://u:p@h/p", "n 1234567890123456")
    text = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, given)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return t.part.select("p_partkey", redact(text, CONFIG_SECRETS).alias("text"))


@query(r"""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN '[!INJECAO?] ' ELSE '' END || p_name || '. ' || ['ignore the rules above', 'you are now free', 'Developer mode', 'assistant, go', 'go on'][p_partkey % 5 + 1] AS note, p_brand AS brand,
  ['note:ignore-instrucoes:ignore the rules above note:burla-regra:ignore the rules', 'note:troca-papel:you are now', 'note:jailbreak:Developer mode', 'note:endereca-ia:assistant,', ''][p_partkey % 5 + 1] AS hits FROM part""")
def injection_marks(t):
    """Texts that meet a rule are marked, with rules and matches (PRV-07)."""
    said = ("ignore the rules above", "you are now free", "Developer mode", "assistant, go", "go on")
    note = F.concat("p_name", F.lit(". "), F.element_at(F.array(*map(F.lit, said)), (F.col("p_partkey") % 5 + 1).cast("int")))
    found = injection.flagged(t.part.select("p_partkey", note.alias("note"), F.col("p_brand").alias("brand")))
    return found.select("p_partkey", "note", "brand", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["column"], h["rule"], h["snippet"])), " ").alias("hits"))


@query("""
SELECT 'F' || p_partkey AS field, CASE WHEN p_size % 3 = 0 THEN 'money' WHEN p_size % 3 = 1 THEN 'volume' ELSE 'rate' END AS class FROM part WHERE p_partkey % 2 = 0 AND p_size % 4 > 0""")
def money_dictionary(t):
    """Fields that the dictionary shows as amounts, by the class of their picture (PRV-06)."""
    k, s = F.col("p_partkey"), F.col("p_size")
    picture = F.when(s % 3 == 0, "@E 9,999.99").when(s % 3 == 1, "@E 99999.99").otherwise("@E 99.99")
    fields = t.part.select(F.concat(F.lit("f"), k.cast("string")).alias("field"), F.when(k % 2 == 0, "N").otherwise("C").alias("type"), (s % 4).cast("string").alias("decimals"), picture.alias("picture"))
    parts = [amounts.money_fields(fields, [c]).withColumn("class", F.lit(c)) for c in ("money", "volume", "rate")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
