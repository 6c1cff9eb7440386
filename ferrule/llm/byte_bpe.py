"""Byte-level BPE encoding and decoding by a rank file, with the tokenizers library over Arrow batches.

A text is cut at every single space between two non-space characters; such a space always starts a new match of the
pattern, so the pieces can be encoded apart. The distinct pieces of a portion of an Arrow batch are encoded at once: their
bytes are mapped to the vocabulary's characters here, the library merges them. Ids, their decimal text and the decoded
bytes of all texts are then gathered by numpy. Pieces stay in two generations of tables, bounded in bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import table

#: Bytes that a generation of known pieces takes, by estimate, and bytes of text worked on at a time (one text at least).
KNOWN_BYTES, PORTION = 48 << 20, 8 << 20
#: Bytes of text at a time where tokens are only counted.
COUNTED = 1 << 20
_SPLIT = re.compile(r"(?<!\s) (?!\s)")
#: A space beside white space of any kind, in the syntax of Arrow's patterns.
_CLOSE = r" [\s\v\x1c-\x1f\x{85}\p{Z}]|[\s\v\x1c-\x1f\x{85}\p{Z}] "
#: Letters and signs on whose kind all pattern libraries agree; pieces with others are cut by the tokenizers library.
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\u052f\u3041-\u30ff\u4e00-\u9fff\uac00-\ud7a3]*")
_codecs: dict[str, Codec] = {}


def byte_chars() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the rest follows from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    out |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two bytes or more is made of: what is left when only lower ranks are merged."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encodes and decodes by one vocabulary; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], pairs: list[tuple[bytes, bytes]], pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        shown = lambda token: "".join(chars[b] for b in token)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        back = {c: b for b, c in chars.items()}
        vocab = {shown(token): rank for token, rank in ranks.items()}
        for text, rank in vocab.items():
            self.bytes_of[rank] = bytes(back[c] for c in text)
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[(shown(a), shown(b)) for a, b in pairs], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # the same vocabulary without a pattern, for pieces that were cut and mapped before
        self.merger = Tokenizer(models.BPE(vocab=vocab, merges=[(shown(a), shown(b)) for a, b in pairs], ignore_merges=True))
        self.pattern, self.chars = regex.compile(pattern), chars
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        width = len(str(len(self.bytes_of))) + 1
        self.digits = np.frombuffer(b"".join(f"{k},".encode().ljust(width, b"\0") for k in range(len(self.bytes_of))), np.uint8).reshape(-1, width)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as the bytes of 32-bit numbers."""
        plain = [bool(_PLAIN.fullmatch(p, p.startswith(" "))) for p in pieces]
        words, counts = [], []
        for p, easy in zip(pieces, plain):
            own = self.pattern.findall(p) if easy else ()
            words += own
            counts.append(len(own))
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.chars).split(self.chars[10]) if words else []
        batches = [mapped[k : k + 4096] for k in range(0, len(mapped), 4096)]
        found = [e.ids for e in self.merger.encode_batch_fast(batches, add_special_tokens=False, is_pretokenized=True)]
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        # a token ends where its bytes do, so the ends of words tell whose it is
        words_end = np.cumsum(np.fromiter(map(len, mapped), np.int64, len(mapped)))
        ends = np.append(0, np.searchsorted(np.cumsum(self.length[ids]), words_end) + 1)[np.cumsum([0, *counts])]
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
        other = [k for k, easy in enumerate(plain) if not easy]
        for k, e in zip(other, self.tokenizer.encode_batch_fast([pieces[k] for k in other], add_special_tokens=False)):
            out[k] = np.array(e.ids, np.int32).tobytes()
        return out

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those met before come from the tables."""
        young, old = self.known
        found = [young.get(p) for p in pieces]
        missing = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in missing:
            found[k] = old.get(pieces[k])
            if found[k] is None:
                new.append(k)
        for at in range(0, len(new), 1 << 16):
            some = new[at : at + (1 << 16)]
            for k, ids in zip(some, self._merge([pieces[k] for k in some])):
                found[k] = ids
        for k in missing:
            if len(pieces[k]) <= 256:  # longer ones hardly come again
                self.known[0][pieces[k]] = found[k]
                self.held += 200 + len(pieces[k]) + len(found[k])
                if self.held > KNOWN_BYTES:
                    self.known, self.held = ({}, self.known[0]), 0
        return found

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(piece number of each place, first place of each text and the end, distinct pieces)."""
        odd = pc.match_substring_regex(texts, _CLOSE).to_numpy(zero_copy_only=False)
        if odd.any():
            lists = [_SPLIT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd)]
            bounds = np.cumsum([0, *map(len, lists)])
            flat = pa.array([p for parts in lists for p in parts], pa.large_string())
        else:
            parts = pc.split_pattern(texts, " ")
            bounds, flat = parts.offsets.to_numpy().astype(np.int64), parts.values
            flat, bounds = flat.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]
        first = np.zeros(len(flat), bool)
        first[bounds[:-1]] = True
        code = np.empty(len(flat), np.int64)
        head, rest = (flat.filter(pa.array(x)).dictionary_encode() for x in (first, ~first))
        code[~first] = rest.indices.to_numpy()
        code[first] = head.indices.to_numpy() + len(rest.dictionary)
        return code, bounds, [*[" " + p for p in rest.dictionary.to_pylist()], *head.dictionary.to_pylist()]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts (large_string, no nulls) -> all their ids, and where each text's begin, with the end."""
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        code, bounds, pieces = self._pieces(texts)
        found = self._ids_of(pieces)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        ends = np.cumsum(size[code])
        return flat[_places(np.cumsum(size) - size, size, code)], np.append(0, ends)[bounds]

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has; the ids themselves are put together for no text."""
        if not len(texts):
            return np.empty(0, np.int64)
        code, bounds, pieces = self._pieces(texts)
        size = np.fromiter(map(len, self._ids_of(pieces)), np.int64, len(pieces)) // 4
        return np.diff(np.append(0, np.cumsum(size[code]))[bounds])

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of one text, and the same as decimal numbers joined by commas."""
        ids, bounds = self.encode_all(pa.array([text], pa.large_string()))
        return ids.tolist(), bytes(self.shown(ids, bounds)[0]).decode()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def shown(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """Decimal ids joined by commas, of each text."""
        rows = self.digits[ids]
        ends = np.append(0, np.cumsum((rows != 0).sum(axis=1)))[bounds].tolist()
        data = memoryview(rows[rows != 0])
        return [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each text's ids."""
        ends = np.append(0, np.cumsum(self.length[ids]))[bounds].tolist()
        data = memoryview(self.data[_places(self.start, self.length, ids)])
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that each token covers, [start, end); a token within a character covers that character."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length[ids])
        return char[ends - self.length[ids]], char[ends - 1] + 1


def _places(start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the values of ``rows``, one row's after another's, where row k has size[k] values from start[k] on."""
    n = size[rows]
    ends = np.cumsum(n)
    return np.repeat(start[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _portions(texts: pa.Array, portion: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """Neighbouring texts of ``portion`` (or PORTION) bytes or so, nulls as empty, and the place of the first."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (portion or PORTION), "right")))
        yield at, texts.slice(at, to - at)
        at = to


def _shared(spark, path: str, pattern: str):
    """A function that gives the worker's codec. The rank file is read once, by the driver; its size is fixed."""
    ranks = read_ranks(path)
    sent = spark.sparkContext.broadcast((ranks, merges(ranks), pattern))
    key = hashlib.sha256(repr((path, len(ranks), pattern)).encode()).hexdigest()

    def codec() -> Codec:
        if key not in _codecs:
            _codecs[key] = Codec(*sent.value)
        return _codecs[key]

    return codec


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        return public_tokenizers.PATTERN
    return pattern


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """``docs`` -> (id, ids, starts, ends): token ids and the characters [start, end) that each covers.

    One row per row, repeated rows included; a null or empty text has no tokens. Texts are encoded whole. Other columns
    are not read; an empty table gives an empty result. ``path`` is the rank file.
    """
    codec = _shared(docs.sparkSession, path, _pattern(pattern))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, ints) for c in ("ids", "starts", "ends")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            for at, texts in _portions(b.column(1)):
                ids, bounds = c.encode_all(texts)
                each = [c.offsets(t, ids[x:y]) if y > x else ((), ()) for t, x, y in zip(texts.to_pylist(), bounds.tolist(), bounds[1:].tolist())]
                cols = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), *[pa.array([e[k] for e in each], pa.list_(pa.int32())) for k in range(2)]]
                yield pa.record_batch([b.column(0).slice(at, len(texts)), *cols], names=["id", "ids", "starts", "ends"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def decode(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids) -> (id, data, text): the bytes of the ids and their text.

    Ids may start or end within a character: ``data`` is exact, and in ``text`` each broken character is U+FFFD. Null ids,
    alone or in the list, stand for no bytes; an id out of the vocabulary is an error.
    """
    codec = _shared(rows.sparkSession, path, _pattern(None))
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("data", T.BinaryType()), T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            data = [c.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary()), pa.array([d.decode(errors="replace") for d in data], pa.string())], names=["id", "data", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(work, schema)


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """``docs`` -> (id, n_tokens): as ``round_trip``, without ids, decoded bytes and hashes."""
    codec = _shared(docs.sparkSession, path, _pattern(pattern))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            for at, texts in _portions(b.column(1), COUNTED):
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(c.count_all(texts), pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """``docs`` -> (id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both hashed.

    One row per row, repeated rows included; a null text is empty; whole texts; other columns are not read; an empty table
    gives an empty result.
    """
    codec = _shared(docs.sparkSession, path, _pattern(pattern))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            for at, texts in _portions(b.column(1)):
                ids, bounds = c.encode_all(texts)
                hashes = [[hashlib.sha256(x).hexdigest() for x in of(ids, bounds)] for of in (c.shown, c.decoded)]
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(np.diff(bounds)), *map(pa.array, hashes)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")
