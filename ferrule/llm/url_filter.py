"""URL verdicts: host and path rules, and a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models, of the URLs that rules allow and of those they block, give each URL a
log-likelihood difference per character. The threshold is calibrated on the same URLs, each scored by models that never
saw its fold. Counts are exact and stay in Spark, however many contexts the URLs hold.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.llm.common import Tables, portions, table
from ferrule.llm.grams import codes, least_count, pairs

#: Fixed values: (host, path, verdict) of the default rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Longest context, and weight of the next shorter context.
ORDER, SHORTER = 4, 2.0
#: Grams (contexts with a sign), at most, whose values are sent to the tasks that read the URLs; the rest is joined.
LOCAL = 1 << 18
#: Bins of the calibration, over log-likelihood differences per character from -SPAN to SPAN.
BINS, SPAN = 2000, 5.0


def _asciilower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: str) -> tuple[Column, Column]:
    """Host and path columns of a URL column; both empty for null and where there is no ://."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    return _asciilower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path joined) and its verdict, or nulls. The rules are a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, label, fold) -> gram and how often it stands in the URLs of each label and fold, and in those without a label."""
    for b in portions(batches, 0):
        label, fold = (pc.fill_null(c, -1).to_numpy(zero_copy_only=False) for c in b.columns[1:])
        kind = np.where(label < 0, 4, label * 2 + fold)
        for k in np.unique(kind).tolist():
            grams, n = np.unique(codes(b.column(0).filter(pa.array(kind == k)), b"", True, ORDER)[1], return_counts=True)
            yield pa.record_batch([pa.array(grams), *[pa.array(n.astype(np.int64) if k == j else np.zeros(len(n), np.int64)) for j in range(5)]], names=["gram", *_COUNTS, "other"])


#: Counts of a gram: by label (0 blocked, 1 allowed) and fold. Models: of all URLs, and of one fold's.
_COUNTS = ("n00", "n01", "n10", "n11")
_MODELS = ("both", "fold0", "fold1")


def _of_model(model: str, label: int, prefix: str = "n") -> Column:
    folds = (0, 1) if model == "both" else (int(model[-1]),)
    return sum((F.col(f"{prefix}{label}{f}") for f in folds), F.lit(0))


def differences(urls: DataFrame, tables: Tables) -> DataFrame:
    """(url, label, fold) -> gram, n_all and, for each model, what its last sign adds to the log-likelihood difference.

    Counts are exact, of every distinct context and sign. Those of a shorter context are sums over the longer ones. Level by level
    each order leans on the next shorter one, the shortest on 256 equal signs; a level joins a gram to its shorter one and adds up
    the signs of its context, groups of at most 256 rows.
    """
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    counts = urls.select("url", "label", "fold").mapInArrow(_counted, "gram long, n00 long, n01 long, n10 long, n11 long, other long")
    levels = {ORDER: tables.write("grams", counts.groupBy("gram").agg(*sums, F.sum("other").alias("other")))}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = tables.write(f"grams{k}", levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(*sums))
    done, chances = None, [f"p_{m}{y}" for m in _MODELS for y in (0, 1)]
    for k in range(ORDER + 1):
        level, after = levels[k], Window.partitionBy(F.shiftright("gram", 8))
        if done is None:
            level = level.withColumns({f"up_{c}": F.lit(1 / 256) for c in chances})
        else:
            up = done.select(F.col("gram").alias("up"), *[F.col(c).alias(f"up_{c}") for c in chances])
            level = level.withColumn("up", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(up, "up").drop("up")
        level = level.withColumns({f"of_{c}": F.sum(c).over(after) for c in _COUNTS})
        smoothed = {f"p_{m}{y}": (_of_model(m, y) + SHORTER * F.col(f"up_p_{m}{y}")) / (_of_model(m, y, "of_n") + SHORTER) for m in _MODELS for y in (0, 1)}
        done = level.withColumns(smoothed).drop(*[f"up_{c}" for c in chances], *[f"of_{c}" for c in _COUNTS])
    n_all = sum((F.col(c) for c in _COUNTS), F.col("other"))
    out = tables.write("differences", done.select("gram", n_all.alias("n_all"), *[F.log(F.col(f"p_{m}1") / F.col(f"p_{m}0")).alias(m) for m in _MODELS]))
    tables.drop("grams", *[f"grams{k}" for k in range(ORDER)])
    return out


_FOUND = ("row", "own", "size", "ratio", "held", "gram", "times")


def _looked_up(own_type: pa.DataType, grams: pa.Array, values: dict[str, np.ndarray]):
    """(own, fold, url) -> a row for each URL with the sums of what is found here, and rows for the grams that are not."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 36, 0
        for b in portions(batches, 2):
            n = b.num_rows
            rows, fold = task + done + np.arange(n), b.column(1).to_numpy()
            done += n
            at, gram = codes(b.column(2), b"", True, ORDER)
            found = pc.fill_null(pc.index_in(pa.array(gram), value_set=grams), -1).to_numpy()
            hit = found >= 0
            owner, place = at[hit], found[hit]
            ratio, held = np.zeros(n), np.zeros(n)
            ratio += np.bincount(owner, values["both"][place], n)
            held += np.bincount(owner, np.where(fold[owner] == 0, values["fold1"][place], values["fold0"][place]), n)  # by the other fold's model
            size, none = np.bincount(at, minlength=n), pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array(rows), b.column(0), *map(pa.array, (size, ratio, held)), none, none], names=_FOUND)
            owner, rest, times = pairs(at[~hit], gram[~hit])
            m, zero = len(rest), pa.array(np.zeros(len(rest)))
            yield pa.record_batch([pa.array(rows[owner]), pa.nulls(m, own_type), pa.array(np.zeros(m, np.int64)), zero, zero, pa.array(rest), pa.array(times)], names=_FOUND)

    return look


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, local: int = LOCAL) -> DataFrame:
    """``pages`` -> (id, host, path, rule, verdict, ratio): allow or block for every row.

    The rule's verdict where one fits, else by the models; ratio is the log-likelihood difference per character of every
    row. A null URL counts as empty. Where no URL is allowed by rule, or none is blocked, the models can't tell and allow.
    Other columns are not read; repeated rows count as often as they stand; an empty table gives an empty result. At most
    ``local`` grams, the most frequent, are sent to the tasks that read the URLs; the others are joined.
    """
    tables = Tables(pages.sparkSession)
    plain = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("u"))
    host, path = host_path("u")
    split = plain.select("id", "u", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = split.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), F.col("u").alias("url"), F.pmod(F.xxhash64("u"), F.lit(2)).cast("int").alias("fold"))
    each = differences(rows.select("url", (F.col("ruled") == "allow").cast("int").alias("label"), "fold"), tables)
    sent = each.where(F.col("n_all") >= least_count(each, local)).select("gram", *_MODELS).toArrow()
    own = rows.select(F.struct("id", "host", "path", "rule", "ruled", "fold").alias("own"), "fold", "url")
    own_type = own.schema["own"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("own", own_type), T.StructField("size", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("ratio", "held")], *[T.StructField(c, T.LongType()) for c in ("gram", "times")]])
    look = _looked_up(to_arrow_type(own_type), sent["gram"].combine_chunks(), {m: sent[m].to_numpy() for m in _MODELS})
    found = tables.write("urls", own.mapInArrow(look, schema))
    rest = found.where("gram is not null").select("row", "gram", "times").join(each.drop("n_all"), "gram")
    more = rest.groupBy("row").agg(*[F.sum(F.col("times") * F.col(m)).alias(m) for m in _MODELS])
    added = lambda m: F.coalesce(F.col(f"m.{m}"), F.lit(0.0))
    texts = found.where("gram is null").alias("u").join(more.alias("m"), F.col("u.row") == F.col("m.row"), "left")
    held = F.col("u.held") + F.when(F.col("own.fold") == 0, added("fold1")).otherwise(added("fold0"))
    scored = tables.write("scored", texts.select("own.*", ((F.col("u.ratio") + added("both")) / F.col("size")).alias("ratio"), (held / F.col("size")).alias("held")))
    label = (F.col("ruled") == "allow").cast("int").alias("label")
    place = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN - 1e-9), F.col("held"))) + SPAN) * (BINS / (2 * SPAN))).cast("int").alias("bin")
    bins = scored.where("ruled is not null").select(label, place).groupBy("label", "bin").count()
    threshold = calibrate([(r["label"], r["bin"], r["count"]) for r in bins.collect()])  # at most 2 * BINS rows
    by_model = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return scored.select("id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "ratio")


def calibrate(bins: list[tuple[int, int, int]]) -> float:
    """The threshold with the fewest errors, both classes weighing alike; the middle of the best stretch."""
    n = np.zeros((2, BINS))
    for label, b, count in bins:
        n[label, b] += count
    if not n.sum(axis=1).all():
        return float("-inf")
    blocked, allowed = n / n.sum(axis=1, keepdims=True)
    error = np.append(0, np.cumsum(allowed)) + 1 - np.append(0, np.cumsum(blocked))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    first = best[0]
    last = first + int(np.argmax(np.append(np.diff(best) > 1, True)))
    return float((first + last) / 2 * (2 * SPAN / BINS) - SPAN)


def op5(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
