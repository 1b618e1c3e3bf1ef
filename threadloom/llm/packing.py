"""Best-fit packing of token pieces by exact-complement hashing.

The plan needs only how many pieces there are of each length, at most ``capacity`` counts.  An index
holds for each sum a single length, a pair and a triple that make it and are still available.  From the
longest down, a length's complement to the capacity is looked up there, and as many sequences as the
counts allow are filled exactly at once.  The lengths that no available combination completes are packed
by best fit, which looks up the gap that is left after each piece as well.  The pieces themselves are
numbered within their length and look up their place in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

CAPACITY = 2048
CACHE = 400_000
RANK_ROWS = 100_000


class Encoder:
    """Token ids of whole blocks of texts.

    A byte-level BPE works on pre-tokens alone, so each distinct pre-token goes through the tokenizer
    once a worker and texts are put together from a table of known ones.  Pre-tokens are found in numpy
    for texts of Latin code points; a text with any other, or with the content of an added token, which the
    tokenizer takes out before it cuts pre-tokens, goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kind = np.full(0x250, 9, np.uint8)
        for c in range(0x250):
            ch = chr(c)
            if regex.fullmatch(r"\p{L}", ch):
                self.kind[c] = 1
            elif regex.fullmatch(r"\p{N}", ch):
                self.kind[c] = 2
            elif 0x1C <= c <= 0x1F or regex.fullmatch(r"\p{Cn}", ch):
                pass
            else:
                self.kind[c] = 3 if regex.fullmatch(r"\s", ch) else 0
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def holders(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """The texts in which an added token's content begins."""
        at = []
        for content in self.added:
            i = raw.find(content)
            while i >= 0:
                at.append(i)
                i = raw.find(content, i + 1)
        return np.unique(np.searchsorted(offs, np.array(at, np.int64), "right") - 1)

    def starts(self, cp: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each code point; ``edge`` marks the first of each text."""
        c = self.kind[np.minimum(cp, 0x24F)]
        s = c == 3
        before, after_s, last = np.empty_like(c), np.empty_like(s), np.empty_like(edge)
        before[0], before[1:] = 255, c[:-1]
        before[edge] = 255
        after_s[-1], after_s[:-1] = False, s[1:]
        last[-1], last[:-1] = True, edge[1:]
        blank = np.zeros_like(edge)
        blank[1:] = cp[:-1] == 32
        blank &= ~edge
        out = np.where(s, (before != 3) | (~last & ~after_s), (before != c) & ~blank)
        # English contractions at the start of a run of marks.
        q = np.flatnonzero((cp == 39) & out & ~last)
        if len(q):
            padded, ends = np.append(cp, [0, 0, 0]), np.append(last, [True] * 3)
            one = np.isin(padded[q + 1], [ord(x) for x in "stmd"])
            two = padded[q + 1] * 256 + padded[q + 2]
            two = ~one & ~ends[q + 1] & np.isin(two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
            for hit, n in ((one, 2), (two, 3)):
                i = q[hit]
                out[i + 1] = False
                j = i[~ends[i + n - 1]] + n
                out[j[c[j] == 1]] = True
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, first id of each text with the total last)."""
        n = len(offs) - 1
        lead = (data & 0xC0) != 0x80
        byte_at = np.flatnonzero(lead)
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(cp) != len(byte_at):
            raise ValueError("text is not UTF-8")
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        cp_offs = np.searchsorted(byte_at, offs)
        odd = np.flatnonzero((cp >= 0x250) | (self.kind[np.minimum(cp, 0x24F)] == 9))
        slow = np.union1d(np.searchsorted(cp_offs, odd, "right") - 1, self.holders(raw, offs))
        edge = np.zeros(len(cp), bool)
        edge[cp_offs[:-1][np.diff(cp_offs) > 0]] = True
        start = self.starts(cp, edge)
        for d in slow:
            start[cp_offs[d] : cp_offs[d + 1]] = False
        tok = np.flatnonzero(start)
        first = np.searchsorted(tok, cp_offs)
        b0 = byte_at[tok]
        # A pre-token ends where the next begins, or with its text.
        doc = np.repeat(np.arange(n), np.diff(first))
        b1 = np.minimum(np.append(b0[1:], len(data)), offs[doc + 1]) if len(tok) else b0
        h = B.word_hashes(data, b0, b1)
        own, at0, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        where = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == own[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            ids = self.whole([raw[b0[i] : b1[i]].decode() for i in at0[new].tolist()])
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.append(self.pool, np.zeros_like(self.pool))
            self.pool[self.used : self.used + len(flat)] = flat
            place = np.searchsorted(self.keys, own[new])
            self.at = np.insert(self.at, place, self.used + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.keys = np.insert(self.keys, place, own[new])
            self.used += len(flat)
            where = np.searchsorted(self.keys, own)
        at, size = self.at[where][inv], self.size[where][inv]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(at - (end - size), size) + np.arange(total)]
        count = np.concatenate([[0], end])[first]
        if not len(slow):
            return ids, count
        parts = [ids[count[d] : count[d + 1]] for d in range(n)]
        for d, x in zip(slow.tolist(), self.whole([raw[offs[d] : offs[d + 1]].decode() for d in slow.tolist()]), strict=True):
            parts[d] = x
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for a worker process: what it has learnt serves later tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and then ``end_id``.

    A document longer than ``capacity`` is cut into pieces of ``capacity``, what is over coming first.
    A null or empty text is the end id alone.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, n, data, offs in B.text_blocks(batch, block_bytes=1 << 20):
                ids, first = enc.encode(data, offs)
                out: dict[str, list] = {f.name: [] for f in schema}
                for d in range(n):
                    own = np.append(ids[first[d] : first[d + 1]].astype("<u4"), tail)
                    raw = own.tobytes()
                    at, k = 0, 0
                    while at < len(own):
                        size = (len(own) - at) % capacity or capacity
                        out["doc_id"].append(doc_ids[a + d])
                        out["piece"].append(k)
                        out["start"].append(at)
                        out["length"].append(size)
                        out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        if with_ids:
                            out["ids"].append(own[at : at + size].astype(np.int64))
                        at, k = at + size, k + 1
                yield B.row_batch(schema, **out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def stored_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces as a table in the shared folder: texts are tokenized once, whatever reads the pieces."""
    return B.stored(pieces(docs, tokenizer, capacity), "pieces", B.bucket_count(docs))


class SumIndex:
    """Combinations of one, two or three available lengths, by their sum.

    ``have`` holds how many pieces there are of each length, without those ``reserved`` for the sequence at
    hand.  Taken pieces never come back, so what was found stays good until one of its lengths runs out, and
    a sum that nothing makes while none is reserved stays so.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        self.reserved: list[int] = []
        self.known: dict[tuple[int, int], tuple[int, ...] | None] = {}

    def reserve(self, lengths: tuple[int, ...]) -> None:
        for x in lengths:
            self.have[x] -= 1
        self.reserved += lengths

    def use(self) -> tuple[list[int], int]:
        """The reserved pieces as a sequence, as many times as the counts allow."""
        for x in self.reserved:
            self.have[x] += 1
        lengths, uses = np.unique(self.reserved, return_counts=True)
        n = int((self.have[lengths] // uses).min())
        self.have[lengths] -= n * uses
        pattern, self.reserved = sorted(self.reserved, reverse=True), []
        return pattern, n

    def available(self, lengths: tuple[int, ...]) -> bool:
        return all(self.have[x] >= lengths.count(x) for x in lengths)

    def _look_up(self, many: int, total: int) -> tuple[int, ...] | None:
        known = self.known.get((many, total), ())
        if known is None or known and self.available(known):
            return known
        found = (self._pair if many == 2 else self._triple)(total)
        if found or not self.reserved:
            self.known[many, total] = found
        return found

    def _pair(self, total: int) -> tuple[int, ...] | None:
        """The most plentiful pair."""
        if total < 2:
            return None
        a = np.arange(1, total // 2 + 1)
        n = np.minimum(self.have[a], self.have[total - a])
        if total % 2 == 0:
            n[-1] = self.have[total // 2] // 2
        k = int(n.argmax())
        return (total - int(a[k]), int(a[k])) if n[k] > 0 else None

    def _triple(self, total: int) -> tuple[int, ...] | None:
        """A triple of the longest length that has one."""
        for c in np.flatnonzero(self.have[: max(total - 1, 0)])[::-1].tolist():
            two = self._look_up(2, total - c)
            if two and not self.available((c, *two)):
                self.have[c] -= 1
                two = self._pair(total - c)
                self.have[c] += 1
            if two:
                return (c, *two)
        return None

    def find(self, total: int) -> tuple[int, ...] | None:
        """The available combination of fewest lengths that makes the total, or None."""
        if self.have[total]:
            return (total,)
        return self._look_up(2, total) or self._look_up(3, total)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences) that use every piece once.

    A sequence begins with the longest length left.  If one to three available lengths complete it exactly,
    they do; else the longest that fits goes in (at once where the gap is over three times the longest
    length) and the gap that it leaves is looked up again.  Each step exhausts a length, so there are few
    steps whatever the counts.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    index, out = SumIndex(have), []
    while len(left := np.flatnonzero(have)):
        longest = int(left[-1])
        index.reserve((longest,))
        gap = capacity - longest
        while gap:
            fill = index.find(gap) if gap <= 3 * longest else None
            if fill is None:
                fits = np.flatnonzero(have[: gap + 1])
                if not len(fits):
                    break
                fill = (int(fits[-1]),)
            index.reserve(fill)
            gap -= sum(fill)
        out.append(index.use())
    return out


def _places(planned: list[tuple[list[int], int]]) -> np.ndarray:
    """The plan as rows (length, first rank, first sequence, uses in a sequence, offset in it), sorted by length and rank."""
    rows, seq, rank = [], 0, {}
    for pattern, n in planned:
        lengths, uses = np.unique(pattern, return_counts=True)
        offset = 0
        for x, k in zip(lengths.tolist(), uses.tolist(), strict=True):
            rows.append((x, rank.get(x, 0), seq, k, offset))
            rank[x] = rank.get(x, 0) + n * k
            offset += x * k
        seq += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...), which must be a stored table.

    Pieces of a length are numbered in hash buckets of about ``rank_rows`` rows offset by the counts
    before, so that a length that many pieces have is no single task's work.  Equal rows are packed
    each.  No pieces, no sequences.
    """
    spark = cut.sparkSession
    buckets = max(1, -(-cut.count() // rank_rows))
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = B.stored(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "pack-counts", max(8, buckets))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(_places(plan(lengths, capacity)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if buckets * len(lengths) <= B.BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")))
    ranked = ranked.join(offsets, ["length", "_bucket"]).select(*cut.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    names = cut.columns

    @B.tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        key = (rows[:, 0] << 48) + rows[:, 1] if len(rows) else rows
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            p = rows[np.searchsorted(key, (length << 48) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            j = rank - p[:, 1]
            cols = [*(batch.column(i) for i in range(len(names))), pa.array(p[:, 2] + j // np.maximum(p[:, 3], 1)), pa.array(p[:, 4] + (j % np.maximum(p[:, 3], 1)) * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, cut.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long")
