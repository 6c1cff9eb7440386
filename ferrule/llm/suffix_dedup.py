"""Exact substring dedup over suffixes: bytes covered by a string of LENGTH bytes that also starts elsewhere go.

A full suffix array of the corpus would order suffixes that no repeat of LENGTH bytes can tie. Here every window (the first
LENGTH bytes of a suffix) belongs to the suffix bucket of its anchor, the GRAM-byte string within it that hashes lowest;
equal windows have equal anchors at equal distance, so only suffixes of one bucket can tie. A run of windows with one
anchor is a stretch.

1. Stretches are hashed where the documents lie: a few dozen bytes for about 170 bytes of text are shuffled, no text.
   Stretches whose whole content occurs twice are settled by counting, before and after the shuffle.
2. Buckets with two different stretches or more are sorted, one at a time or several small ones in a block of bounded
   size: suffixes by their first V bytes, longer ties by ranks of a difference-cover sample, precomputed by doubling.
   Neighbours in that order that share LENGTH bytes are repeats.
3. A bucket above CROWDED stretches (a passage at the edge of which very many documents part) isn't sorted in one task:
   its windows are counted by their 128-bit hash over all tasks.

Passages of WORDS words or more can have fewer than LENGTH bytes. They are found apart from this (repeated_passages).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import Tables, portions, table

LENGTH = 400
GRAM = 64
#: Words of a passage that is cut out of texts wherever it repeats, however few bytes they have, and words of its anchor.
WORDS, WORD_GRAM = 51, 16
#: Difference cover: modulus and residues; each residue is a difference of two of them.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Windows of a chunk that is hashed at a time; longer documents are cut there.
CHUNK = 1 << 20
#: Bytes of stretches that are sorted at a time, and stretches of a bucket that one task sorts at most.
BLOCK, CROWDED = 1 << 20, 2048
_LOW = np.uint64((1 << 21) - 1)
#: Words of more bytes are hashed one by one; signs that part words; masks of 0 to 8 bytes.
_SHORT = 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTES = np.random.default_rng(400).integers(1 << 62, size=256, dtype=np.uint64)


def _hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    h, width = _BYTES[buf], 1
    for f in _FACTORS:
        h = h[: len(h) - width] * f + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts buf[bounds[k]:bounds[k + 1]] -> (text, first window, windows, bytes from it to the anchor, anchor's hash)."""
    if len(buf) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    h = _hashes(buf)
    at = (_lowest((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    end = np.append(new[1:], len(at))
    end = np.minimum(end, bounds[text[new] + 1] - LENGTH + 1)  # windows end within their text
    own = end > new
    new, end = new[own], end[own]
    return text[new], new, end - new, at[new] - new, h[at[new]]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents by their offsets -> (document, byte bounds) of neighbours of CHUNK bytes or so; long ones in pieces."""
    docs, bounds = [], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if docs and (b - bounds[0] > CHUNK):
            yield np.array(docs), np.array([*bounds, a])
            docs, bounds = [], []
        if b - a > CHUNK:
            for s in range(a, b - LENGTH + 1, CHUNK - LENGTH):
                yield np.array([k]), np.array([s, min(s + CHUNK - 1, b)])
        else:
            docs.append(k)
            bounds.append(a)
            last = b
    if docs:
        yield np.array(docs), np.array([*bounds, last])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kid", "ktext", "g", "h", "at"]
    for b in portions(batches, 2, 16 << 20):
        data, offsets = _values(b.column(2))
        kid, ktext = b.column(0).to_numpy(), b.column(1).to_numpy()
        raw = memoryview(data)
        for docs, bounds in _chunks(offsets):
            text, first, n, lead, g = stretches(data[bounds[0] : bounds[-1]], bounds - bounds[0])
            if not len(text):
                continue
            start = first + bounds[0]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, [raw[s:e] for s, e in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]), np.uint64, len(n))
            doc = docs[text]
            at = ((start - offsets[doc]) << 20) | (n << 10) | lead
            yield pa.record_batch([pa.array(x) for x in (kid[doc], ktext[doc], g.view(np.int64), h.view(np.int64), at)], names=names)


def _words(buf: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first V bytes from each position as big-endian numbers of 8 bytes, first ones first; the last holds V % 8."""
    out = []
    wide = np.lib.stride_tricks.sliding_window_view(buf, 8)
    for k in range(0, V, 8):
        w = np.ascontiguousarray(wide[at + k]).view(">u8")[:, 0].astype(np.uint64)
        out.append(w >> np.uint64(8 * (8 - V % 8)) if V - k < 8 else w)
    return out


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by keys, first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_block(buf: np.ndarray, bucket: np.ndarray, start: np.ndarray, n: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Windows of the stretches of whole buckets, all in ``buf`` -> for each window whether LENGTH bytes of it repeat.

    Stretch k lies at start[k] and holds n[k] windows, in order; its anchor is lead[k] bytes after its start.
    """
    total = int(n.sum())
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    delta = lead[owner] - j
    group = bucket[owner] * LENGTH + delta
    repeated = np.zeros(total, bool)
    _, inverse, size = np.unique(group, return_inverse=True, return_counts=True)
    live = np.flatnonzero(size[inverse] > 1)  # a suffix alone in its place of the bucket ties with none
    if not len(live):
        return repeated
    window = start[owner[live]] + j[live]
    padded = np.concatenate([buf, np.zeros(2 * LENGTH + 2 * V, np.uint8)])

    # ranks of the sample: positions whose distance to the stretch's anchor is in the cover, modulo V
    lengths = n + LENGTH - 1
    own = np.repeat(np.arange(len(n)), lengths)
    pos = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cover = np.zeros(V, bool)
    cover[list(COVER)] = True
    sampled = cover[(pos - lead[own]) % V]
    sample = (start[own] + pos)[sampled]
    place = np.full(len(padded), -1, np.int64)
    place[sample] = np.arange(len(sample))
    rank, depth = _ranks(_words(padded, sample)), V
    while depth < LENGTH:
        far = place[np.minimum(sample + depth, len(padded) - 1)]
        rank = _ranks([rank, np.where(far >= 0, rank[far], -1)])
        depth *= 2

    # a suffix's first sample position: the same distance for all suffixes of a group, so ranks there compare
    step = np.array([min(d for d in range(V) if cover[(r + d) % V]) for r in range(V)])
    tie = rank[place[window + step[(-delta[live]) % V]]]
    order = np.lexsort([tie, *_words(padded, window)[::-1], group[live]])
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero(group[live[a]] == group[live[b]])
    a, b = a[pair], b[pair]
    wide = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    for at in range(0, len(pair), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        same = (wide[window[x]] == wide[window[y]]).all(axis=1)
        repeated[live[x[same]]] = True
        repeated[live[y[same]]] = True
    return repeated


def _spans(kid, ktext, p1, n, settled, repeated) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of unsettled stretches as byte spans."""
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(repeated & ~settled[owner])
    if len(hit):
        new = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
        first, last = hit[new], hit[np.append(new[1:], True)]
        own = owner[first]
        yield pa.record_batch([pa.array(kid[own]), pa.array(ktext[own]), pa.array((p1[own] + j[first]).astype(np.int64)), pa.array((p1[own] + j[last] + LENGTH).astype(np.int64))], names=["kid", "ktext", "start", "end"])


_CUT = "g long, kid long, ktext int, at long, settled boolean, data binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their open stretches -> the stretches' bytes."""
    for b in batches:
        kid, ktext, texts, lists = b.column(0), b.column(1), b.column(2), b.column(3)
        for k in range(b.num_rows):
            data = texts[k].as_py()
            rows = lists[k].as_py()
            cut = [data[(r["at"] >> 20) : (r["at"] >> 20) + (r["at"] >> 10 & 1023) + LENGTH - 1] for r in rows]
            m = len(rows)
            yield pa.record_batch(
                [pa.array([r["g"] for r in rows], pa.int64()), pa.array([kid[k].as_py()] * m, pa.int64()), pa.array([ktext[k].as_py()] * m, pa.int32()), pa.array([r["at"] for r in rows], pa.int64()), pa.array([r["settled"] for r in rows], pa.bool_()), pa.array(cut, pa.binary())],
                names=["g", "kid", "ktext", "at", "settled", "data"],
            )


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches ordered by bucket -> repeated spans; whole buckets, BLOCK bytes or one bucket at a time."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = _values(t.column("data").combine_chunks())
        g, at = t.column("g").to_numpy(), t.column("at").to_numpy()
        n, lead = at >> 10 & 1023, at & 1023
        bucket = np.cumsum(np.append(0, g[1:] != g[:-1]))
        base = int(offsets[0])
        buf = data[base : int(offsets[-1])]
        repeated = sort_block(buf, bucket, offsets[:-1] - base, n, lead)
        yield from _spans(t.column("kid").to_numpy(), t.column("ktext").to_numpy(), at >> 20, n, t.column("settled").to_numpy(), repeated)

    rest, last = None, None
    for b in batches:
        t = pa.Table.from_batches([b])
        told = [t.column(c).to_numpy() for c in ("g", "kid", "ktext", "at")]  # repeated rows hold the same stretch: once is enough
        new = np.append(last != [x[0] for x in told], sum(x[1:] != x[:-1] for x in told) > 0) if t.num_rows else np.zeros(0, bool)
        if not new.any():
            continue
        last = [x[-1] for x in told]
        t = t.filter(pa.array(new))
        rest = t if rest is None else pa.concat_tables([rest, t])
        while True:
            g = rest.column("g").to_numpy()
            size = np.cumsum(rest.column("at").to_numpy() >> 10 & 1023) + LENGTH * np.arange(1, len(g) + 1)
            new = np.flatnonzero(g[1:] != g[:-1]) + 1
            full = new[size[new - 1] <= BLOCK]
            cut = int(full[-1]) if len(full) else int(new[0]) if len(new) else 0
            if not cut or size[-1] <= BLOCK:
                break
            yield from settle(rest.slice(0, cut))
            rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from settle(rest)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of crowded buckets -> a 128-bit hash of each window."""
    for b in batches:
        for k in range(b.num_rows):
            data, at = b.column(5)[k].as_py(), b.column(3)[k].as_py()
            view, n = memoryview(data), at >> 10 & 1023
            w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[j : j + LENGTH]) for j in range(n)]), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(n, b.column(1)[k].as_py())), pa.array(np.full(n, b.column(2)[k].as_py(), np.int32)), pa.array((at >> 20) + np.arange(n)), pa.array([b.column(4)[k].as_py()] * n, pa.bool_())],
                names=["w1", "w2", "kid", "ktext", "start", "settled"],
            )


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word; words are parted by \\x20 and \\x09-\\x0D."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw[:-8]]
    turn = np.flatnonzero(np.diff(inside))
    start, end = turn[::2], turn[1::2]
    size = end - start
    h = size.astype(np.uint64) * _FACTORS[0]
    lanes = np.ndarray(len(data) + 1, "<u8", raw, 0, (1,))
    todo = np.arange(len(start))
    for k in range(0, _SHORT, 8):  # eight bytes at a time; what lies behind the word is masked
        todo = todo[size[todo] > k]
        x = (h[todo] ^ (lanes[start[todo] + k] & _MASKS[np.minimum(size[todo] - k, 8)])) * _FACTORS[1]
        x ^= x >> np.uint64(32)
        h[todo] = x * _FACTORS[2]
    for k in todo[size[todo] > _SHORT].tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    h ^= h >> np.uint64(29)
    return h, start, end


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> hash, first byte and end of each word, counted within its text, and the bounds of the texts among the words."""
    texts = [x.as_buffer() if x.is_valid else b"" for x in column]
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    words, start, end = _word_hashes(b" ".join(texts))
    bounds = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return words, start - base, end - base, bounds


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> stretches of windows of WORDS words with one anchor, the WORD_GRAM words that hash lowest."""
    names, piece = ["kid", "ktext", "g", "h", "first", "n", "start", "end"], 1 << 20
    for b in portions(batches, 2):
        kid, ktext = b.column(0).to_numpy(), b.column(1).to_numpy()
        words, start, end, bounds = _joined(b.column(2))
        text = np.repeat(np.arange(b.num_rows), np.diff(bounds))
        raw = memoryview(words).cast("B")
        for s in range(0, len(words) - WORDS + 1, piece):
            g, width = words[s : s + piece + WORDS - 1], 1
            while width < WORD_GRAM:
                g = g[: len(g) - width] * _FACTORS[width.bit_length()] + g[width:]
                width *= 2
            g = (g ^ (g >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
            g ^= g >> np.uint64(29)
            at = (_lowest((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), WORDS - WORD_GRAM + 1) & _LOW).astype(np.int64)
            own = text[s : s + len(at)]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
            stop = np.minimum(np.append(first[1:], len(at)), bounds[own[first] + 1] - s - WORDS + 1)  # windows end within their text
            whole = stop > first
            first, stop = first[whole], stop[whole]
            if not len(first):
                continue
            anchor, doc, n = g[at[first]], own[first], stop - first
            first = s + first
            last = first + n + WORDS - 1
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, [raw[i:j] for i, j in zip((8 * first).tolist(), (8 * last).tolist())]), np.uint64, len(n))
            columns = (kid[doc], ktext[doc], anchor.view(np.int64), h.view(np.int64), first - bounds[doc], n, start[first], end[last - 1])
            yield pa.record_batch([pa.array(x) for x in columns], names=names)


def _word_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their open stretches -> a 128-bit hash and the bytes of each window of WORDS words."""
    for b in portions(batches, 2, 1 << 20):
        words, start, end, bounds = _joined(b.column(2))
        rows = b.column(3).flatten()
        n = rows.field("n").to_numpy()
        doc = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
        at = np.arange(n.sum()) + np.repeat(bounds[doc] + rows.field("first").to_numpy() - (np.cumsum(n) - n), n)
        settled = np.repeat(rows.field("settled").to_numpy(zero_copy_only=False), n)
        raw, doc = memoryview(words).cast("B"), np.repeat(doc, n)
        w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[j : j + 8 * WORDS]) for j in (8 * at).tolist()]), "<i8").reshape(-1, 2)
        kid, ktext = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
        yield pa.record_batch([pa.array(x) for x in (w[:, 0], w[:, 1], kid, ktext, start[at], end[at + WORDS - 1], settled)], names=["w1", "w2", "kid", "ktext", "start", "end", "settled"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (kid, ktext, spans): by document key the byte spans of its passages of WORDS words that also start elsewhere.

    As repeated_spans, by words instead of bytes: the kind of white space between words doesn't count. Windows of open
    stretches are counted by their 128-bit hash over all tasks.
    """
    t = Tables(docs.sparkSession)
    keyed = docs.select(*_key(id_col, text_col))
    found = t.write("runs", keyed.mapInArrow(_word_runs, "kid long, ktext int, g long, h long, first long, n long, start long, end long"))
    one = [F.first(c).alias(c) for c in ("kid", "ktext", "first", "n")]
    kinds = t.write("run_kinds", found.groupBy("g", "h").agg((F.count("*") > 1).alias("settled"), *one))
    buckets = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g")
    settled = t.write("settled_runs", found.join(kinds.where("settled").select("g", "h"), ["g", "h"], "left_semi").select("kid", "ktext", "start", "end"))
    t.drop("runs")
    rows = kinds.join(buckets, "g", "left_semi").groupBy("kid", "ktext").agg(F.collect_list(F.struct("first", "n", "settled")).alias("rows"))
    open_ = t.write("open_runs", rows)
    t.drop("run_kinds")
    cut = keyed.join(open_, ["kid", "ktext"]).select("kid", "ktext", "data", "rows")
    windows = t.write("word_windows", cut.mapInArrow(_word_windows, "w1 long, w2 long, kid long, ktext int, start long, end long, settled boolean"))
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    more = t.write("more_runs", windows.where("not settled").join(twice, ["w1", "w2"], "left_semi").select("kid", "ktext", "start", "end"))
    t.drop("open_runs", "word_windows")
    return settled.unionByName(more).groupBy("kid", "ktext").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """``docs`` -> (kid, ktext, spans): by document key the byte spans of its repeated strings, overlapping, unordered.

    The key is the hashed id and the hashed text, so repeated rows share one; keys without spans are absent. A null text is
    empty; an empty table gives an empty result.
    """
    t = Tables(docs.sparkSession)
    keyed = docs.select(*_key(id_col, text_col))
    found = t.write("stretches", keyed.mapInArrow(_find, "kid long, ktext int, g long, h long, at long"))
    kinds = t.write(
        "kinds",
        found.groupBy("g", "h").agg((F.count("*") > 1).alias("settled"), F.first("kid").alias("kid"), F.first("ktext").alias("ktext"), F.first("at").alias("at")),
    )
    buckets = t.write("buckets", kinds.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    at = F.shiftrightunsigned("at", 20)
    settled = t.write(
        "settled",
        found.join(kinds.where("settled").select("g", "h"), ["g", "h"], "left_semi").select(
            "kid", "ktext", at.alias("start"), (at + F.shiftrightunsigned("at", 10).bitwiseAND(1023) + LENGTH - 1).alias("end")
        ),
    )
    t.drop("stretches")
    open_ = t.write(
        "open",
        kinds.join(buckets, "g").groupBy("kid", "ktext").agg(F.collect_list(F.struct("g", "at", "settled", (F.col("n") > crowded).alias("crowded"))).alias("rows")),
    )
    t.drop("kinds")

    def cut(keep) -> DataFrame:
        some = open_.select("kid", "ktext", F.filter("rows", keep).alias("rows")).where(F.size("rows") > 0)
        return keyed.join(some, ["kid", "ktext"]).select("kid", "ktext", "data", "rows").mapInArrow(_cut, _CUT)

    spans = cut(lambda r: ~r["crowded"]).repartition("g").sortWithinPartitions("g", "kid", "ktext", "at").mapInArrow(_sort, "kid long, ktext int, start long, end long")
    spans = settled.unionByName(t.write("sorted", spans))
    if buckets.where(F.col("n") > crowded).limit(1).count():
        windows = t.write("windows", cut(lambda r: r["crowded"]).mapInArrow(_windows, "w1 long, w2 long, kid long, ktext int, start long, settled boolean"))
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        more = windows.where("not settled").join(twice, ["w1", "w2"], "left_semi").select("kid", "ktext", "start", (F.col("start") + LENGTH).alias("end"))
        spans = spans.unionByName(t.write("more", more))
    # a set: repeated rows share a key and have the same spans
    return spans.groupBy("kid", "ktext").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _key(id_col: str, text_col: str) -> list:
    """kid, ktext, data: the hashed id, the hashed text, the text's bytes."""
    text = F.col(f"`{text_col}`").cast("string")
    return [F.xxhash64(F.col(f"`{id_col}`")).alias("kid"), F.hash(text).alias("ktext"), F.coalesce(text, F.lit("")).cast("binary").alias("data")]


def remove(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    kept, at, runs, open_ = [], 0, 0, -1
    for start, end in sorted(spans):
        if start > open_:
            kept.append(data[at:start])
            runs += 1
        open_ = max(open_, end)
        at = open_
    return b"".join([*kept, data[at:]]), runs


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, kept binary, n_bytes, n_spans, text, n_passage_bytes, n_passages): each text without what repeats.

    A byte is not in ``kept`` if a string of LENGTH bytes that covers it also starts anywhere else, the same document
    included; ``n_spans`` counts the removed runs. The passages of WORDS words that also start elsewhere, whatever their
    bytes, are told apart from that: ``n_passage_bytes`` is what they cover, ``n_passages`` their maximal runs. ``text``
    has neither, as in dedup_texts, and loses the bytes of characters that a cut leaves broken. One row per row; repeated
    rows count as repeats of each other; a null text is empty; other columns are not read; an empty table gives an empty
    result.
    """
    names = ["id", "kept", "n_bytes", "n_spans", "text", "n_passage_bytes", "n_passages"]
    types = [docs.schema[id_col].dataType, T.BinaryType(), T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(*x) for x in zip(names, types)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, *found in zip(b.column(1), b.column(2), b.column(3)):
                data = data.as_py()
                spans, passages = ([(x["start"], x["end"]) for x in f.as_py() or []] for f in found)
                kept, runs = remove(data, spans)
                rest, n = remove(data, passages)
                text = remove(data, spans + passages)[0] if passages else kept
                rows.append((kept, len(data), runs, text.decode(errors="ignore"), len(data) - len(rest), n))
            cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
            yield pa.record_batch([b.column(0), *cols], names=names)

    arrow = [pa.field(n, t) for n, t in zip(names[1:], (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
    passages = repeated_passages(docs, id_col, text_col).withColumnRenamed("spans", "passages")
    spans = repeated_spans(docs, id_col, text_col)
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return (
        whole.select("id", *_key("id", "text"))
        .join(spans, ["kid", "ktext"], "left")
        .join(passages, ["kid", "ktext"], "left")
        .select("id", "data", "spans", "passages")
        .mapInArrow(work, schema)
    )


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts, all rows and columns kept.

    Cut are strings of LENGTH bytes and passages of WORDS words, whatever their bytes, that stand anywhere else too.
    Bytes of a character that a cut leaves broken go too. ``length_col``, where there is one, holds the new number of
    characters. A null text stays null; repeated rows count as repeats of each other; an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(at), b.column(b.num_columns - 1)):
                s = spans.as_py()
                texts.append(remove(text.as_py().encode(), [(x["start"], x["end"]) for x in s])[0].decode(errors="ignore") if s else text.as_py())
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.record_batch(cols, names=columns)

    columns = docs.columns
    at = columns.index(text_col)
    spans = repeated_spans(docs, id_col, text_col).unionByName(repeated_passages(docs, id_col, text_col))
    spans = spans.groupBy("kid", "ktext").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    key = _key(id_col, text_col)[:2]
    taken = {c.lower() for c in docs.columns}
    names = [next(n for n in (c + "_" * k for k in range(99)) if n.lower() not in taken) for c in ("kid", "ktext", "spans")]
    spans = spans.toDF(*names)
    joined = docs.select("*", key[0].alias(names[0]), key[1].alias(names[1])).join(spans, names[:2], "left")
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], names[2]).mapInArrow(work, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed, "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text", "n_passage_bytes", "n_passages")
