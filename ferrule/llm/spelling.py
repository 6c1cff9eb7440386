"""Spelling variants: words at one inserted, deleted or replaced character of another, grouped under their commonest form.

The comparison is a bit-sliced position index. For a block of words each (position, letter) has a bitset of the words with that
letter there; a query walks along its letters and carries four bitsets over the block at once: no error yet, one replacement, one
letter more in the word (compared one place further on), one letter less (one place back). Every error set is entered where the
first letters differ, and only there, so each near word is found once.

Two words with one error between them share the first half or the last half of the shorter one. So words meet in buckets of equal
halves, for the length of the shorter word, and a pair belongs to the bucket in whose gap the first difference
lies. A crowded bucket is split the same way: its gap is halved, and words also share the half without the error. That ends with a
gap of one letter, where a bucket can only hold a few thousand words. A bucket is never paired off; a word leaves it
with the number of its near words and the commonest of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import Tables, lexical_id, pieces, portions, table
from ferrule.llm.resampling import CRC_TABLE, crc_sql

#: What parts words once A-Z are lower-cased, and the ASCII signs among it.
_BETWEEN, _END = r"[^a-z\x{C0}-\x{FF}]+", re.compile(rb"[\x00-\x60\x7B-\x7F]")
#: One in SLIPS runs of a document loses a character; a form is at least DOMINANCE times as common as its variant.
SLIPS, LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 31, 7, 2, 10
#: Words of a block of small buckets; a larger bucket is a block of its own, up to CROWDED (or 1/65,536 of all rows).
BLOCK, CROWDED = 1024, 4096
#: 64-bit words of a bitset table of one tile of queries.
TILE = 1 << 20


def _counted(slips: int, least: int):
    """(id as text, text) -> word, n: the runs of a portion, some with a character lost, each with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            begins = [zlib.crc32(i + b":") for i in b.column(0).cast(pa.binary()).to_pylist()]
            for base, part, _, _ in pieces(pc.ascii_lower(b.column(1)), _END):
                lists = pc.split_pattern_regex(part, _BETWEEN)
                runs, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
                long = pc.greater_equal(pc.utf8_length(runs), least)
                coded = pc.dictionary_encode(runs.filter(long))
                names, v = coded.dictionary, max(1, len(coded.dictionary))
                owner = owner.filter(long).to_numpy().astype(np.int64) + base
                pairs, times = np.unique(owner * v + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                owner, code = pairs // v, pairs % v
                data = names.cast(pa.binary()).to_pylist()
                h = np.array([zlib.crc32(data[c], begins[o]) for o, c in zip(owner.tolist(), code.tolist())], np.int64)
                slip = h % slips == 0
                yield pa.record_batch([names, pa.array(np.bincount(code[~slip], times[~slip], len(names)).astype(np.int64))], names=["word", "n"])
                cut, n = [], []
                for c, crc, k in zip(code[slip].tolist(), h[slip].tolist(), times[slip].tolist()):
                    word = data[c].decode()
                    at = crc % len(word)
                    if len(word) > least:
                        cut.append(word[:at] + word[at + 1 :])
                        n.append(k)
                yield pa.record_batch([pa.array(cut, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with at least so many characters and occurrences."""
    plain = docs.select(lexical_id(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    words = plain.mapInArrow(_counted(slips, least_length), "word string, n long").where("n > 0")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class _Index:
    """The (position, letter) bitsets of a block of gap strings, bit k for word k."""

    def __init__(self, gaps: list[bytes], length: int) -> None:
        n = len(gaps)
        self.width = -(-n // 64)
        data = np.frombuffer(b"".join(g.ljust(length, b"\0") for g in gaps), np.uint8).reshape(n, length)
        letters = np.unique(data[data > 0])
        code = np.zeros(256, np.int64)
        code[letters] = np.arange(1, len(letters) + 1)
        self.letters, self.codes = letters, code[data]
        self.data = data

    def at(self, position: int) -> np.ndarray:
        """A bitset for each letter (0: no letter) at a position; empty beyond the ends."""
        out = np.zeros((len(self.letters) + 1, self.width), np.uint64)
        if 0 <= position < self.data.shape[1]:
            out[1:] = _packed(self.letters[:, None] == self.data[:, position], self.width)
        return out


def _packed(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of truth values as bitsets."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    full = np.zeros((*bits.shape[:-1], width * 8), np.uint8)
    full[..., : packed.shape[-1]] = packed
    return full.view("<u8").astype(np.uint64, copy=False)


def near_in_block(gaps: list[bytes], bucket: np.ndarray, gap: int, open_end: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, bitsets of their near words), tile by tile, for gap strings of ``gap`` or ``gap`` + 1 letters.

    Words are near if they lie in one bucket and their gap strings differ by one replaced letter, or by one letter more, with
    the first difference inside the gap of the shorter one; at an open end (no shared rest) also just behind it.
    """
    index = _Index(gaps, gap + 1)
    sizes = np.array([len(g) for g in gaps])
    short, long = _packed(sizes == gap, index.width), _packed(sizes == gap + 1, index.width)
    none = np.uint64(0)
    kinds = [(np.flatnonzero(sizes == gap), False), (np.flatnonzero(sizes == gap + 1), True)]
    step = max(64, TILE // index.width)
    for of_kind, longer in kinds:
        for start in range(0, len(of_kind), step):
            q = of_kind[start : start + step]
            exact = _packed(bucket[q][:, None] == bucket[None, :], index.width)
            replaced, more, less = np.zeros_like(exact), np.zeros_like(exact), np.zeros_like(exact)
            back, here, ahead = index.at(-1), index.at(0), index.at(1)
            for i in range(gap + longer):
                letter = index.codes[q, i]
                same = here[letter]
                wrong = exact & ~same if i < gap else none
                if longer:
                    less = (less & back[letter]) | wrong
                else:
                    replaced = (replaced & same) | wrong
                    more = (more | wrong) & ahead[letter]
                if i < gap:
                    exact &= same
                back, here, ahead = here, ahead, index.at(i + 2)
            end = exact if open_end else none
            yield q, (less | end) & short if longer else (replaced & short) | ((more | end) & long)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, list[bytes], np.ndarray, int, bool]]:
    """Words, counts, gap strings and buckets of blocks of whole buckets that share (length, shared start, shared end)."""
    kind, held, last = None, [], None
    start = 0  # where the last bucket begins

    def block():
        a, x, y = kind
        order = sorted(range(len(held)), key=lambda k: (-held[k][1], held[k][0]))  # the commonest first: the lowest bit of a bitset
        rows = [held[k] for k in order]
        gaps = [w[x : len(w) - y].encode("latin-1") for w, _, _ in rows]
        return [w for w, _, _ in rows], np.array([n for _, n, _ in rows], np.int64), gaps, np.array([b for _, _, b in rows]), a - x - y, y == 0

    bucket = 0
    for b in batches:
        for word, n, a, x, y in zip(*(c.to_pylist() for c in b.columns)):
            key = (word[:x], word[len(word) - y :])
            if (a, x, y) != kind or key != last:
                if len(held) - start == 1:  # a bucket of one word has no pair
                    held.pop()
                if held and ((a, x, y) != kind or len(held) >= BLOCK):
                    yield block()
                    held = []
                kind, last, start, bucket = (a, x, y), key, len(held), bucket + 1
            held.append((word, n, bucket))
    if len(held) - start == 1:
        held.pop()
    if held:
        yield block()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> word, near, best_n, best: how many near words it has in a bucket, and the commonest."""
    for words, n, gaps, bucket, gap, open_end in _blocks(batches):
        for q, found in near_in_block(gaps, bucket, gap, open_end):
            near = np.bitwise_count(found).sum(1, dtype=np.int64)
            some = np.flatnonzero(near)
            first = (found[some] != 0).argmax(1)
            value = found[some, first]
            best = first * 64 + np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            yield pa.record_batch(
                [pa.array([words[k] for k in q[some]], pa.string()), pa.array(near[some]), pa.array(n[best]), pa.array([words[k] for k in best], pa.string())], names=["word", "near", "best_n", "best"]
            )


_KEY = ["a", "x", "y", "head", "tail"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.expr("left(word, x)"), "tail": F.expr("right(word, y)")})


def _halves(rows: DataFrame) -> DataFrame:
    """The two buckets of each row whose gap is half of its bucket's: the error lies behind the middle, or before it."""
    middle = F.floor((F.col("x") + F.col("a") - F.col("y")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("x"), F.col("y")), F.struct(F.col("x"), (F.col("a") - middle).alias("y")))
    return rows.select("word", "n", "a", F.explode(halves).alias("half")).select("word", "n", "a", "half.x", "half.y")


def near_words(words: DataFrame, tables: Tables, crowded: int = CROWDED) -> DataFrame:
    """word, n_near, best_n, best for the words (distinct, of Latin-1 letters, with counts n) that have near words."""
    length = F.char_length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("a")).select("word", "n", "a", F.lit(0).alias("x"), F.lit(0).alias("y"))
    rows, settled, step = tables.write("halves", _keyed(_halves(start))), [], 0
    bound = max(crowded, rows.count() // 65_536)
    while True:
        hot = rows.groupBy(*_KEY).count().where((F.col("count") > bound) & (F.col("a") - F.col("x") - F.col("y") > 1)).drop("count")
        hot = tables.write(f"crowded{step}", hot)
        if hot.isEmpty():
            break
        few = F.broadcast(hot)  # at most 65,536 buckets have so many of the rows
        settled.append(rows.join(few, _KEY, "left_anti"))
        rows = tables.write(f"halves{step}", _keyed(_halves(rows.join(few, _KEY, "left_semi"))))
        step += 1
    for more in settled:
        rows = rows.unionByName(more)
    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY).select("word", "n", "a", "x", "y")
    found = dealt.mapInArrow(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slips: int = SLIPS,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    dominance: int = DOMINANCE,
    crowded: int = CROWDED,
) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with its near words counted and its form.

    A word's form is its commonest near word (ties: the smallest in code-point order) if that is at least ``dominance`` times as
    common. The root is where the forms of forms end; since counts grow tenfold a step, chains have under 20 links.

    Null and empty texts have no words; a null id counts as empty in the hash that loses characters. Repeated rows count each
    time. An empty table, or one without words, gives an empty result. Other columns are ignored, whatever their names. A run of
    any length is one word.
    """
    tables = Tables(docs.sparkSession)
    words = tables.write("words", vocabulary(docs, id_col, text_col, slips, least_length, least_count))
    near = near_words(words, tables, crowded)
    formed = F.col("best_n") >= dominance * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    forms = tables.write("forms", forms)
    links, step = forms.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:  # each round doubles the links that are followed
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = tables.write(f"roots{step}", links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        links, moved, step = after.select("word", "root"), after.where("moved").isEmpty(), step + 1
        if moved:
            break
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all documents' words."""
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
runs AS (
  SELECT r, doc_id, w, count(*) k FROM (
    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) w
    FROM (SELECT row_number() OVER () r, doc_id, text FROM documents)) WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || w")} h FROM runs, crc),
words AS MATERIALIZED (
  SELECT w, sum(k)::BIGINT n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN w[1 : (h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2 :] ELSE w END w, k FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
cut AS MATERIALIZED (SELECT w, n, p, w[1 : p] || w[p + 2 :] rest FROM words, LATERAL (SELECT unnest(range(length(w))) p)),
pairs AS MATERIALIZED (
  SELECT a.w, b.w v, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cut a JOIN words b ON a.rest = b.w
  UNION SELECT b.w, a.w, a.n FROM cut a JOIN words b ON a.rest = b.w),
near AS (SELECT w, count(*) n_near, max(n) top FROM pairs GROUP BY w),
best AS (SELECT w, n_near, top, min(v) v FROM near JOIN pairs USING (w) WHERE n = top GROUP BY ALL),
forms AS MATERIALIZED (SELECT words.w, n, coalesce(n_near, 0) n_near, CASE WHEN top >= 10 * n THEN v END form, CASE WHEN top >= 10 * n THEN top END form_n FROM words LEFT JOIN best USING (w)),
walk AS (SELECT w, w root, form ahead FROM forms UNION ALL SELECT walk.w, ahead, forms.form FROM walk JOIN forms ON forms.w = ahead)
SELECT w AS word, form, root, n, n_near, form_n FROM forms JOIN (SELECT w, root FROM walk WHERE ahead IS NULL) USING (w)
"""
