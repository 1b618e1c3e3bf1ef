"""Substring deduplication with a compressed FM-index per shard.

A window of 13 words is sharded by its minimizer, the least hash of the six-word grams in it, so equal
windows meet in one shard and no shard is searched for all documents.  Runs of windows with one
minimizer travel together as a segment.  A shard's distinct segments are indexed: the Burrows-Wheeler
transform of their words in a wavelet matrix shaped by an entropy code, so a frequent word takes few
bits, and the least document of every 13-word interval.  The suffix array isn't kept.  Then the shard's
segments of every document are streamed through the index, from their last word to their first: backward
search carries the longest match that begins at each word (the matching statistics), and where it reaches
13 words its interval is reported and compared with the document.

A minimizer that many segments have, as one in a common passage, is split: its windows are sharded one
by one, by their own hashes, so its shard doesn't grow with the number of documents around the passage,
and their places are streamed past the index.

Words are 64-bit hashes in the index, and a match means that 13 of them agree, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WINDOW, GRAM, LONGEST = 13, 6, 32
#: A cut list of at most so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Input bytes of one shard, and the most bytes of the filter of shared minimizers.
SHARD_BYTES, FILTER_BYTES = 4 << 20, 64 << 20
#: Segments that are searched at a time.
SEARCH_ROWS = 1 << 15
#: Split windows that a task remembers to have sent to the index; then it forgets them and may send them again.
KNOWN_WINDOWS = 1 << 19
#: Segments of one minimizer from which on its windows are sharded one by one, and the most minimizers so
#: listed; where there are more, the limit is doubled until the list is as short.
SPLIT_SEGMENTS, SPLIT_MOST = 4_096, 1 << 20
_LEVELS = 40
_STEP = np.uint64(0xD6E8FEB86659FD93)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of a text in the order of their next symbols, ``depth`` or more of them."""
    n, width = len(text), max(1, 62 // max(1, int(text.max(initial=0)).bit_length()))
    width = min(width, depth)
    bits = max(1, int(text.max(initial=0)).bit_length())
    rank = np.zeros(n, np.int64)
    padded = np.append(text.astype(np.int64), np.zeros(width, np.int64))
    for j in range(width):
        rank = (rank << bits) | padded[j : j + n]
    order = np.argsort(rank)
    while width < depth:
        s = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1])) + 1
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        rank = rank * (n + 1) + after
        order = np.argsort(rank)
        width *= 2
    return order


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol in an entropy code (Shannon's): the rounded-up logarithm of how rare it is; 0 for one that doesn't occur."""
    n = counts.sum()
    own = np.maximum(1, np.ceil(np.log2(n / np.maximum(counts, 1)) - 1e-9)).astype(np.int64)
    return np.where(counts > 0, own, 0)


def codes(length: np.ndarray) -> np.ndarray:
    """Prefix-free codes of these lengths, first bit lowest, for a wavelet matrix.

    A matrix puts the zeros of a level before its ones, so prefixes lie in the order of their reversed
    bits.  The symbols that end at a level get its largest prefixes: they lie last and can be cut off.
    """
    out = np.zeros(len(length), np.int64)
    left = int((length > 0).sum())
    free = np.zeros(1, np.int64)
    for k in range(1, int(length.max(initial=0)) + 1):
        free = np.concatenate([free, free + (1 << (k - 1))])[:left]
        ends = np.flatnonzero(length == k)
        if len(ends):
            out[ends] = free[len(free) - len(ends) :]
            free = free[: len(free) - len(ends)]
            left -= len(ends)
    return out


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """Packed bits with the number of ones before each 64 of them."""

    def __init__(self, bit: np.ndarray):
        lanes = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bit, bitorder="little")
        lanes[: len(raw)] = raw
        self.lanes = lanes.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.lanes)[:-1], dtype=np.int32)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        lane = at >> 6
        return self.before.take(lane) + np.bitwise_count(self.lanes.take(lane) & _BELOW.take(at & 63))


class FMIndex:
    """A compressed index of a text of integers > 0, with 0 between segments, each place with an owner.

    Kept are the transform as a wavelet matrix (a symbol takes the bits of its code, with half a bit of
    counts each), the common prefixes of neighbouring suffixes up to ``depth``, a byte each, and the least
    owner of every ``depth`` symbols that occur.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int = WINDOW):
        n, self.depth = len(text), depth
        self.size = n
        order = sorted_suffixes(text, depth)
        padded = np.append(text, np.zeros(depth, text.dtype)).astype(np.int32)
        self.common = np.zeros(n, np.uint8)
        alive = np.ones(max(n - 1, 0), bool)
        for d in range(depth):
            symbol = padded[d:].take(order)
            alive &= symbol[1:] == symbol[:-1]
            self.common[1:] += alive
        # The intervals of ``depth`` symbols, by their first places.
        full = self.common < depth
        self.first = Bits(full)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(full)) if n else np.zeros(0, np.int64)
        self._starts: dict[int, tuple[Bits, np.ndarray]] = {}
        seq = text[order - 1].astype(np.int32)
        count = np.bincount(seq, minlength=1)
        self.begin = np.concatenate([[0], np.cumsum(count)])
        self.length = code_lengths(count)
        self.code = codes(self.length)
        self.bits, self.zeros = [], []
        seq = self.code[seq].astype(np.int32)
        for k in range(int(self.length.max(initial=0))):
            bit = ((seq >> k) & 1).astype(bool)
            self.bits.append(Bits(bit))
            zeros = seq[~bit]
            self.zeros.append(len(zeros))
            seq = np.concatenate([zeros, seq[bit]])
            seq = seq[: len(seq) - int(count[self.length == k + 1].sum())]
        # Where each symbol's occurrences begin in its last level, folded into the cumulative counts.
        symbols = np.arange(len(count))
        self.shift = self.begin[:-1] - self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        # Symbols of long codes first: those still on their way are the first ones at each level.
        length = self.length.take(symbol)
        order = np.argsort(-length.astype(np.int8), kind="stable")
        on = len(symbol) - np.cumsum(np.bincount(length, minlength=len(self.bits) + 1))
        code, at = self.code.take(symbol.take(order)), at.take(order)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            n = on[k]
            if not n:
                break
            now = at[:n]
            ones = bits.ones(now)
            at[:n] = np.where((code[:n] >> k) & 1, zeros + ones, now - ones)
        out = np.empty_like(at)
        out[order] = at
        return out

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with a symbol put before them; empty (hi <= lo) where they don't occur so, and for symbols that the text lacks."""
        known = (symbol > 0) & (symbol < len(self.length))
        c = np.where(known, symbol, 0)
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.shift[c]
        x, y = base + both[: len(lo)], base + both[len(lo) :]
        known &= self.length[c] > 0
        return np.where(known, x, 0), np.where(known, y, 0)

    def shortened(self, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols of the matches at these places."""
        if depth not in self._starts:
            marks = self.common < depth if depth else np.arange(self.size) == 0
            self._starts[depth] = Bits(marks), np.append(np.flatnonzero(marks), self.size).astype(np.int32)
        marks, starts = self._starts[depth]
        at = marks.ones(lo + 1)
        return starts.take(at - 1), starts.take(at)

    def matches(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed segments text[begin : begin + size], one after the other.

        For each place of each segment the length of the longest match that begins there and stays in the
        segment, up to ``depth`` symbols, and the first suffix of its interval.  A match is carried from
        place to place: cut to depth - 1 symbols, then grown by the symbol before it; where that doesn't
        occur it's cut further until it does.
        """
        order = np.argsort(-size, kind="stable")
        last, sizes = (begin + size)[order] - 1, size[order]
        place = (np.cumsum(size) - size + size)[order] - 1
        k = len(size)
        length = np.zeros(k, np.int64)
        lo, hi = np.zeros(k, np.int64), np.full(k, self.size, np.int64)
        out_length, out_lo = np.zeros(int(size.sum()), np.uint8), np.zeros(int(size.sum()), np.int32)
        for t in range(int(sizes[0]) if k else 0):
            k = int(np.searchsorted(-sizes, -t, "left"))
            c = text[last[:k] - t]
            m, x, y = length[:k], lo[:k], hi[:k]
            over = np.flatnonzero(m == self.depth)
            x[over], y[over] = self.shortened(x[over], self.depth - 1)
            m[over] = self.depth - 1
            grown = self.step(c, x, y)
            bad = np.flatnonzero(grown[1] <= grown[0])
            while len(bad):
                none = bad[m[bad] == 0]
                grown[0][none], grown[1][none], m[none] = 0, self.size, -1
                bad = bad[m[bad] > 0]
                m[bad] -= 1
                for d in np.unique(m[bad]).tolist():
                    i = bad[m[bad] == d]
                    x[i], y[i] = self.shortened(x[i], d)
                grown[0][bad], grown[1][bad] = self.step(c[bad], x[bad], y[bad])
                bad = bad[grown[1][bad] <= grown[0][bad]]
            lo[:k], hi[:k] = grown
            m += 1
            out_length[place[:k] - t], out_lo[place[:k] - t] = m, lo[:k]
        return out_length, out_lo

    def least_owner(self, lo: np.ndarray) -> np.ndarray:
        """The least owner of the ``depth`` symbols whose interval begins at these suffixes."""
        return self.least.take(self.first.ones(lo))


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, document, first word, windows) of the runs of windows with one minimizer; a run has at most ``longest`` windows."""
    m = len(h) - window + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    v = B.gram_hashes(h, gram)
    left, width = window - gram + 1, 1
    while 2 * width <= left:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if left > width:
        v = np.minimum(v[: len(v) - (left - width)], v[left - width :])
    doc = B.owners(first)
    ok = first[doc[:m] + 1] - np.arange(m) >= window
    p = np.flatnonzero(ok)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    vv, dd = v[p], doc[p]
    new = np.ones(len(p), bool)
    new[1:] = (vv[1:] != vv[:-1]) | (dd[1:] != dd[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(p)))
    if (size > longest).any():
        run = np.repeat(np.arange(len(at)), size)
        inside = np.arange(len(p)) - at[run]
        at = np.flatnonzero(inside % longest == 0)
        size = np.diff(np.append(at, len(p)))
    return vv[at], dd[at], p[at], size


def _hashed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = B.word_spans(B.SPACE[data], offs)
    return B.word_hashes(data, starts, ends), first


def _sequence_hashes(h: np.ndarray, p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences of given lengths that begin at given words."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _STEP)]))
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(h), inverse)]))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    return B.mix(((run[p + words] - run[p]) * down[p]) ^ (words.astype(np.uint64) << np.uint64(56)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each start and size, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


def _files(buckets: int) -> int:
    """Files of a stage's small table: several buckets to each."""
    return max(4, buckets // 8)


def _bloom_bits(v: np.ndarray, size: int, hashes: int) -> np.ndarray:
    """The filter positions of each minimizer, a row each; one where the filter is so full that a second would only fill it more."""
    both = [(v >> np.uint64(7)) % np.uint64(size), *([B.mix(v ^ _STEP) % np.uint64(size)] if hashes > 1 else [])]
    return np.stack(both).astype(np.int64)


def shared_minimizers(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """A stored table of the minimizers that several documents have, as blobs with their number; only their windows can be repeated.

    In a block of texts a minimizer goes on once, with one of its documents, its distinct segments and
    whether it has several documents, so a passage that a third of all documents have is sent once a
    block.  ``often`` holds those with many segments, each with its level (how often SPLIT_SEGMENTS has
    to be doubled to exceed its segments), and ``levels`` their numbers by level.
    """
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])

    @B.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = B.ids(batch)
            for a, n, data, offs in B.text_blocks(batch, block_bytes=2 * B.BLOCK_BYTES):
                h, first = _hashed(data, offs)
                v, doc, p, size = segments(h, first, window)
                seg = _sequence_hashes(h, p, size + window - 1)
                doc = doc_ids[a : a + n][doc]
                order = np.lexsort((seg, v))
                v, doc, seg = v[order], doc[order], seg[order]
                at = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
                if not len(at):
                    continue
                many = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
                new = np.append(True, (v[1:] != v[:-1]) | (seg[1:] != seg[:-1]))
                distinct = np.add.reduceat(new.astype(np.int32), at)
                bucket = B.mix(v[at]) % np.uint64(buckets)  # minimizers are least hashes, so they aren't even themselves
                rows = [(k, B.pack(v[at[i]], doc[at[i]], distinct[i].astype(np.int32), many[i])) for k, i in B.split_by(bucket)]
                yield B.row_batch(schema, bucket=[r[0] for r in rows], blob=[r[1] for r in rows])

    @B.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in B.per_bucket(batches):
            parts = [B.unpack(blob, "u8", "i8", "i4", "?") for batch in bucket for blob in batch.column(1).to_pylist()]
            v, doc, n, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(v, kind="stable")
            v, doc, n, many = v[order], doc[order], n[order], many[order]
            at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            ok = np.maximum.reduceat(many, at) | (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at))
            v, n = v[at[ok]], np.add.reduceat(n.astype(np.int64), at)[ok]
            hot = np.flatnonzero(n > SPLIT_SEGMENTS)
            level = np.minimum(np.log2(n[hot] / SPLIT_SEGMENTS), _LEVELS - 1).astype(np.int8)
            yield B.row_batch(out, n=[len(v)], blob=[v.tobytes()], often=[B.pack(v[hot], level)], levels=[np.bincount(level, minlength=_LEVELS)])

    out = pa.schema([("n", pa.int64()), ("blob", pa.binary()), ("often", pa.binary()), ("levels", pa.list_(pa.int64()))])
    kind = "n long, blob binary, often binary, levels array<long>"
    return B.stored(B.gathered(docs.mapInArrow(send, "bucket long, blob binary"), buckets).mapInArrow(meet, kind), "fm-minimizers", _files(buckets))


def split_minimizers(shared: DataFrame) -> np.ndarray:
    """The sorted minimizers whose windows are sharded one by one, SPLIT_MOST at most: those of the lowest level from which on they are so few."""
    by_level = shared.agg(*[F.coalesce(F.sum(F.get("levels", F.lit(i))), F.lit(0)).alias(f"l{i}") for i in range(_LEVELS)]).first()
    least = _LEVELS
    while least and sum(by_level[least - 1 :]) <= SPLIT_MOST:
        least -= 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                v, level = B.unpack(blob, "u8", "i1")
                if (level >= least).any():
                    yield B.row_batch(pa.schema([("blob", pa.binary())]), blob=[v[level >= least].tobytes()])

    found = [np.frombuffer(bytes(r["blob"]), np.uint64) for r in shared.select("often").mapInArrow(pick, "blob binary").collect()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def minimizer_filter(shared: DataFrame) -> tuple[np.ndarray, int, int]:
    """A Bloom filter (bits, size, hashes) of the shared minimizers, made by ranges on the executors.

    It has 12 bits for each, FILTER_BYTES at most.  A false hit only sends a segment that no other document
    has: beyond that size hits become more, till a full filter would send all segments.
    """
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    size = int(np.clip(12 * n, 1024, 8 * FILTER_BYTES))
    hashes = 2 if size > 2 * n else 1
    wide = 1 << 20
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    @B.tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                bits = np.unique(_bloom_bits(np.frombuffer(blob, "u8"), size, hashes))
                for k, i in B.split_by(bits // wide):
                    yield B.row_batch(schema, part=[k], blob=[(bits[i] % wide).astype(np.uint32).tobytes()])

    @B.tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(k, np.zeros(wide, bool))[np.frombuffer(blob, np.uint32)] = True
        for k, x in parts.items():
            yield B.row_batch(schema, part=[k], blob=[np.packbits(x).tobytes()])

    out = np.zeros((size // wide + 1, wide // 8), np.uint8)
    kind = "part int, blob binary"
    for r in shared.select("blob").mapInArrow(place, kind).repartition(min(size // wide + 1, B.partitions(shared.sparkSession)), "part").mapInArrow(fill, kind).collect():
        out[r["part"]] = np.frombuffer(bytes(r["blob"]), np.uint8)
    return out.ravel(), size, hashes


def _passes(bloom: tuple[np.ndarray, int, int], v: np.ndarray) -> np.ndarray:
    bits, size, hashes = bloom
    hit = np.ones(len(v), bool)
    for at in _bloom_bits(v, size, hashes):
        hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return hit


def _distinct(seg: np.ndarray, begin: np.ndarray, words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): segments sorted by hash, and whether each differs from the one before it; their words decide, not the hash alone."""
    order = np.argsort(seg)
    new = np.ones(len(seg), bool)
    new[1:] = (seg[order][1:] != seg[order][:-1]) | (words[order][1:] != words[order][:-1])
    at = np.flatnonzero(~new)
    if len(at):
        n = words[order[at]]
        differ = h[_ranges(begin[order[at]], n)] != h[_ranges(begin[order[at - 1]], n)]
        new[at[np.repeat(np.arange(len(at)), n)[differ]]] = True
    return order, new


def _segment_rows(docs: DataFrame, buckets: int, window: int, sent) -> DataFrame:
    """Segments by shard: (bucket, kind, segs, words, places), each block's distinct ones with all their places.

    segs: hash, least document and windows; places: segment, document, text's key and first word.  Kind 0
    is what a shard's index is made of.  Windows of split minimizers go on as kind 0 without places, once a
    task unless a smaller document has them, and as kind 1 with their places, which come after the index.
    """
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("segs", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])

    def rows(kind: int, v: np.ndarray, doc: np.ndarray, key: np.ndarray, p: np.ndarray, at_word: np.ndarray, size: np.ndarray, h: np.ndarray, known: dict[int, int] | None) -> Iterator[tuple]:
        words = size + window - 1
        seg = _sequence_hashes(h, p, words)
        order, new = _distinct(seg, p, words, h)
        which = np.cumsum(new) - 1
        at = order[new]
        if not len(at):
            return
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        local = np.empty(len(seg), np.int64)
        local[order] = which
        shard = seg[at] if known is not None else v[at]
        bucket = B.mix(shard) % np.uint64(buckets)
        place_bucket = bucket[local]
        by_place = dict(B.split_by(place_bucket))
        for b, i in B.split_by(bucket):
            segs, flat = B.pack(seg[at[i]], least[i], size[at[i]].astype(np.int32)), h[_ranges(p[at[i]], words[at[i]])].tobytes()
            own = by_place[b]
            places = B.pack(np.searchsorted(i, local[own]).astype(np.uint32), doc[own], key[own], at_word[own].astype(np.int32))
            if known is None:
                yield b, 0, segs, flat, places
                continue
            yield b, 1, segs, flat, places
            fresh = np.array([known.get(x, least_ + 1) > least_ for x, least_ in zip(seg[at[i]].tolist(), least[i].tolist(), strict=True)])
            if fresh.any():
                j = i[fresh]
                known.update(zip(seg[at[j]].tolist(), least[j].tolist(), strict=True))
                yield b, 0, B.pack(seg[at[j]], least[j], size[at[j]].astype(np.int32)), h[_ranges(p[at[j]], words[at[j]])].tobytes(), b""

    @B.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            doc_ids, keys = B.ids(batch), B.ids(batch, "tkey")
            for a, n, data, offs in B.text_blocks(batch):
                h, first = _hashed(data, offs)
                v, doc, p, size = segments(h, first, window)
                bloom, often = sent.value
                own = _passes(bloom, v)
                v, doc, p, size = v[own], doc[own], p[own], size[own]
                if not len(v):
                    continue
                hot = often[np.minimum(np.searchsorted(often, v), len(often) - 1)] == v if len(often) else np.zeros(len(v), bool)
                out: list[tuple] = []
                for kind, mine in ((0, ~hot), (1, hot)):
                    w, d, q, m = v[mine], doc[mine], p[mine], size[mine]
                    if kind:
                        q, w, d, m = _ranges(q, m), np.repeat(w, m), np.repeat(d, m), np.ones(int(m.sum()), m.dtype)
                    if len(known) > KNOWN_WINDOWS:
                        known.clear()
                    out += rows(kind, w, doc_ids[a : a + n][d], keys[a : a + n][d], q, q - first[d], m, h, known if kind else None)
                yield B.row_batch(schema, **{f.name: [r[i] for r in out] for i, f in enumerate(schema)})

    return docs.mapInArrow(send, "bucket long, kind int, segs binary, words binary, places binary")


class _Shard:
    """The index of a shard's distinct segments."""

    def __init__(self, seg: np.ndarray, doc: np.ndarray, size: np.ndarray, flat: np.ndarray, window: int):
        words = size + window - 1
        begin = np.cumsum(words) - words
        order, new = _distinct(seg, begin, words, flat)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        at = order[new]
        words, begin = words[at], begin[at]
        self.vocab, symbol = np.unique(flat, return_inverse=True)
        #: Of the words that the shard was made of.
        self.symbols = symbol.astype(np.int32) + 1
        text = np.zeros(int(words.sum()) + len(at), np.int32)
        text[_ranges(np.cumsum(words + 1) - (words + 1), words)] = self.symbols[_ranges(begin, words)]
        self.index = FMIndex(text, np.repeat(least, words + 1), window)
        self.window = window

    def symbols_of(self, flat: np.ndarray) -> np.ndarray:
        """The index's symbols of words; 0 for those that it lacks."""
        at = np.minimum(np.searchsorted(self.vocab, flat), len(self.vocab) - 1)
        return np.where(self.vocab[at] == flat, at + 1, 0)

    def search(self, size: np.ndarray, symbols: np.ndarray, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first segment, end, least document of each window) of streamed segments, ``rows`` of them at a time."""
        words = size + self.window - 1
        end = np.cumsum(words)
        for a in range(0, len(size), rows):
            b = min(a + rows, len(size))
            symbol = symbols[end[a] - words[a] : end[b - 1]]
            length, lo = self.index.matches(symbol, end[a:b] - words[a:b] - (end[a] - words[a]), words[a:b])
            reached = length == self.window
            least = np.full(len(symbol), np.iinfo(np.int64).max)
            least[reached] = self.index.least_owner(lo[reached])
            yield a, b, least[_ranges(end[a:b] - words[a:b] - (end[a] - words[a]), size[a:b])]


def _spans(seg: np.ndarray, doc: np.ndarray, key: np.ndarray, at_word: np.ndarray, size: np.ndarray, begin: np.ndarray, least: np.ndarray, window: int) -> tuple[np.ndarray, ...] | None:
    """(document, key, first, end) of the runs of windows that a smaller document has, from places and the windows' least documents."""
    n = size[seg]
    w = _ranges(begin[seg], n)
    row = np.repeat(np.arange(len(seg)), n)
    hit = least[w] < doc[row]
    row, start = row[hit], (at_word[row] + (w - begin[seg][row]))[hit]
    if not len(row):
        return None
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return doc[row[first]], key[row[first]], start[first].astype(np.int32), (start[last] + window).astype(np.int32)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tkey, spans) of the rows with words to remove: spans holds int32 (first, end) word pairs, sorted and apart.

    ``docs`` has (doc_id, text, tkey), tkey a hash of the text: rows are told apart by both.  A window is
    reported where its sequence also starts in a row with a smaller id.  A null id counts as the least.
    """
    buckets = B.bucket_count(docs, SHARD_BYTES)
    shared = shared_minimizers(docs, buckets, window)
    sent = docs.sparkSession.sparkContext.broadcast((minimizer_filter(shared), split_minimizers(shared)))
    place_types = ("u4", "i8", "i8", "i4")

    @B.tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])

        def told(found: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
            if found is not None:
                rows = [(k, B.pack(*(x[i] for x in found))) for k, i in B.split_by(B.mix(found[0].view(np.uint64)) % np.uint64(buckets))]
                yield B.row_batch(schema, bucket=[r[0] for r in rows], blob=[r[1] for r in rows])

        def streamed(shard: _Shard, size: np.ndarray, symbols: np.ndarray, places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            order = np.argsort(places[0], kind="stable")
            seg, doc, key, at_word = (x[order] for x in places)
            for a, b, least in shard.search(size, symbols, SEARCH_ROWS):
                own = slice(*np.searchsorted(seg, [a, b]))
                part = size[a:b]
                yield from told(_spans(seg[own] - a, doc[own], key[own], at_word[own], part, np.cumsum(part) - part, least, window))

        for bucket in B.per_bucket(batches):
            shard: _Shard | None = None
            held: list[list[np.ndarray]] = []
            places: list[list[np.ndarray]] = []

            def build() -> tuple[_Shard, np.ndarray]:
                seg, doc, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))  # noqa: B023
                return _Shard(seg, doc, size.astype(np.int64), flat, window), size.astype(np.int64)

            def cold(size: np.ndarray) -> Iterator[pa.RecordBatch]:
                before = np.cumsum([0, *(len(x[0]) for x in held)])  # noqa: B023
                mine = [np.concatenate(x) for x in zip(*([p[0].astype(np.int64) + before[i], *p[1:]] for i, p in enumerate(places)), strict=True)]  # noqa: B023
                yield from streamed(shard, size, shard.symbols, mine)  # noqa: B023
                shard.symbols = None  # noqa: B023

            for batch in bucket:
                for kind, segs, words, at in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    x = [*B.unpack(segs, "u8", "i8", "i4"), np.frombuffer(words, "u8")]
                    if kind == 0:
                        held.append(x)
                        places.append(B.unpack(at, *place_types))
                        continue
                    if shard is None:
                        # All of the index has come; what is left is streamed past it.
                        shard, size = build()
                        yield from cold(size)
                        held, places, size = [], [], None
                    seg, *rest = B.unpack(at, *place_types)
                    yield from streamed(shard, x[2].astype(np.int64), shard.symbols_of(x[3]), [seg.astype(np.int64), *rest])
            if shard is None:
                shard, size = build()
                yield from cold(size)

    marked = B.gathered(_segment_rows(docs, buckets, window, sent), buckets, "kind").mapInArrow(search, "bucket long, blob binary")

    @B.tidy
    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in B.per_bucket(batches):
            parts = [B.unpack(blob, "i8", "i8", "i4", "i4") for batch in bucket for blob in batch.column(1).to_pylist()]
            d, t, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s, t, d))
            d, t, s, e = d[order], t[order], s[order].astype(np.int64), e[order].astype(np.int64)
            other = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
            shift = (np.cumsum(other) - 1) * (int(e.max()) + 1)
            reach = np.maximum.accumulate(e + shift)
            new = np.ones(len(d), bool)
            new[1:] = s[1:] + shift[1:] > reach[:-1]
            new |= other
            first = np.flatnonzero(new)
            end = reach[np.append(first[1:], len(d)) - 1] - shift[first]
            pair = np.stack([s[first], end], 1).astype(np.int32)
            cut = np.flatnonzero(other[first])
            yield B.row_batch(pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("spans", pa.binary())]), doc_id=d[first][cut], tkey=t[first][cut], spans=[x.tobytes() for x in np.split(pair, cut[1:])])

    return B.stored(B.gathered(marked, buckets).mapInArrow(union, "doc_id long, tkey long, spans binary"), "fm-spans", _files(buckets))


def dedup(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row without the words that repeat a smaller-id document.

    kept_text is null where nothing was removed (the text stands as it was).  Null and empty texts have no
    words.  Texts of under 13 words are kept.  Windows are judged on the input, not on what is left.  Rows
    come out once each and are judged by their own texts, repeated ids too; a null id counts as the least.
    Columns in ``keep`` come along as keep_<name>, whatever their names.
    """
    sent = [c for c in keep if c != "text"]  # the text goes to Python once
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tkey"), *[F.col(c).alias(f"keep_{c}") for c in sent])
    spans = repeated_spans(src.select("doc_id", "text", "tkey"), window)
    size = spans.agg(F.coalesce(F.sum(F.octet_length("spans") + 24), F.lit(0)).alias("b")).first()["b"]
    cuts = spans.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), "spans")
    own = (F.coalesce(src["doc_id"], F.lit(-(1 << 63)).cast("long")) == cuts["_id"]) & (src["tkey"] == cuts["_key"])
    joined = src.join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, own, "left").select("doc_id", "text", "spans", *[f"keep_{c}" for c in sent])
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *[f"keep_{c}" for c in keep]]
    place = {"text": 1, **{c: 3 + i for i, c in enumerate(sent)}}

    @B.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column(2).to_pylist()
            for a, n, data, offs in B.text_blocks(batch):
                sep = B.SPACE[data]
                starts, ends, first = B.word_spans(sep, offs)
                gone = np.zeros(len(starts) + 1, np.int32)
                for d in range(n):
                    if removed[a + d] is not None:
                        pair = np.frombuffer(removed[a + d], np.int32).reshape(-1, 2) + first[d]
                        np.add.at(gone, pair[:, 0], 1)
                        np.add.at(gone, pair[:, 1], -1)
                gone = np.cumsum(gone)[:-1] > 0
                # A kept word goes with one space before it; the first of a document loses the space again.
                own = np.flatnonzero(~gone)
                size = (ends - starts)[own]
                joined_at = np.concatenate([[0], np.cumsum(size + 1)])
                out = np.full(int(joined_at[-1]), 32, np.uint8)
                out[_ranges(joined_at[:-1] + 1, size)] = data[_ranges(starts[own], size)]
                at = np.searchsorted(own, first)
                bound = joined_at[at]
                raw = out.tobytes()
                kept = [raw[i + 1 : j] for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                words, left = np.diff(first), np.diff(at)
                cols = [
                    batch.column(0).slice(a, n), pa.array(words), pa.array(words - left), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array([k.decode() if w != m else None for k, w, m in zip(kept, words.tolist(), left.tolist(), strict=True)], pa.string()),
                    *(batch.column(place[c]).slice(a, n) for c in keep),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + more)
