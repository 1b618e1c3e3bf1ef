"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 3 (the bound of the variable order) with method C escapes
and full exclusion, so the code lengths are those of a true probability distribution.  The statistics are frozen after training:
the code length of a byte is a function of the four bytes that end at it, and is worked out once for
every four bytes seen in training (and once a worker for others), so scoring a text is a table lookup
a byte and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Bytes of text that are counted at once, fours that a task holds at once, and fours whose code lengths are worked out at once.
SLICE, HELD, ROWS = 4 << 20, 1 << 20, 1 << 18
PAD = np.uint8(10)
EXTRA = 400_000


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the four bytes ending at each byte as one integer, the first position of each non-empty document).  A text follows three newlines."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    out = x.copy()
    starts = np.unique(offs[:-1][np.diff(offs) > 0])
    for k in (1, 2, 3):
        back = np.empty(n, np.uint32)
        back[k:] = x[: n - k]
        back[:k] = PAD
        for j in range(k):
            at = starts + j
            back[at[at < n]] = PAD
        # A text shorter than k bytes: its followers are padded through their own starts.
        out |= back << np.uint32(8 * k)
    return out, starts


class Model:
    """Frozen counts of every language, as (languages, keys of four bytes, counts [keys, languages])."""

    def __init__(self, langs: list[str], keys: np.ndarray, counts: np.ndarray):
        self.langs = langs
        self.level = []
        for k in (3, 2, 1, 0):
            part = keys & np.uint32((1 << (8 * (k + 1))) - 1)
            own, inv = np.unique(part, return_inverse=True)
            n = np.zeros((len(own), len(langs)))
            np.add.at(n, inv, counts)
            ctx, cinv = np.unique(own >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, cinv, n)
            np.add.at(kinds, cinv, n > 0)
            self.level.append({"k": k, "keys": own, "n": n, "ctx": ctx, "cinv": cinv, "total": total, "kinds": kinds})
        for up, low in zip(self.level, self.level[1:], strict=False):
            # The counts that a context excludes one level lower, because its own symbols are ruled out by the escape.
            below = low["n"][np.searchsorted(low["keys"], up["keys"] & np.uint32((1 << (8 * (low["k"] + 1))) - 1))]
            up["excluded"] = np.zeros_like(up["total"])
            np.add.at(up["excluded"], up["cinv"], np.where(up["n"] > 0, below, 0))
        self.keys = self.level[0]["keys"]
        self.costs = np.concatenate([self.code_lengths(self.keys[a : a + ROWS]) for a in range(0, max(len(self.keys), 1), ROWS)])

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_, x), max(len(sorted_) - 1, 0))
        return at, (sorted_[at] == x) if len(sorted_) else np.zeros(len(x), bool)

    def code_lengths(self, g: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four under each language, [grams, languages]."""
        m, nl = len(g), len(self.langs)
        cost, done = np.zeros((m, nl)), np.zeros((m, nl), bool)
        prev_ex, prev_kinds = np.zeros((m, nl)), np.zeros((m, nl))
        for lv in self.level:
            part = g & np.uint32((1 << (8 * (lv["k"] + 1))) - 1)
            at, hit = self._find(lv["keys"], part)
            n = np.where(hit[:, None], lv["n"][at], 0)
            cat, chit = self._find(lv["ctx"], part >> np.uint32(8))
            total = np.where(chit[:, None], lv["total"][cat], 0)
            kinds = np.where(chit[:, None], lv["kinds"][cat], 0)
            left, new = total - prev_ex, kinds - prev_kinds
            denom = left + new
            live = ~done & (total > 0) & (denom > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost += np.where(live, np.log2(denom) - np.log2(np.where(n > 0, n, new)), 0)
            done |= live & (n > 0)
            known = total > 0
            prev_kinds = np.where(known, kinds, prev_kinds)
            prev_ex = np.where(known, lv["excluded"][cat] if "excluded" in lv else 0, prev_ex)
        return cost + np.where(done, 0, np.log2(np.maximum(256 - prev_kinds, 1)))


class Scorer:
    """A model's lookup in a worker: pairs of bytes are numbered, and two numbers address a table of the known fours."""

    def __init__(self, model: Model):
        self.model = model
        self.costs = [np.ascontiguousarray(np.append(0.0, model.costs[:, j])) for j in range(len(model.langs))]
        hi, lo = model.keys >> np.uint32(16), model.keys & np.uint32(0xFFFF)
        pairs = np.unique(np.concatenate([hi, lo]))
        self.number = np.zeros(65536, np.int32)
        self.number[pairs] = np.arange(1, len(pairs) + 1)
        self.width = len(pairs) + 1
        self.dense = None
        if self.width <= 4096:
            self.dense = np.zeros(self.width * self.width, np.int32)
            self.dense[self.number[hi].astype(np.int64) * self.width + self.number[lo]] = np.arange(1, len(model.keys) + 1)
        self.more, self.more_costs = np.zeros(0, np.uint32), np.zeros((0, len(model.langs)))

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each document under each language, [documents, languages]; 0 for empty ones."""
        out = np.zeros((len(offs) - 1, len(self.model.langs)))
        g, starts = grams(data, offs)
        if not len(g):
            return out
        if self.dense is not None:
            idx = self.dense[self.number[g >> np.uint32(16)] * np.int64(self.width) + self.number[g & np.uint32(0xFFFF)]]
        else:
            at, hit = Model._find(self.model.keys, g)
            idx = np.where(hit, at + 1, 0)
        docs = np.flatnonzero(np.diff(offs) > 0)
        for j, c in enumerate(self.costs):
            out[docs, j] = np.add.reduceat(c[idx], starts)
        miss = np.flatnonzero(idx == 0)
        if len(miss):
            own, inv = np.unique(g[miss], return_inverse=True)
            at, hit = Model._find(self.more, own)
            if not hit.all():
                new = own[~hit]
                if len(self.more) + len(new) > EXTRA:  # a cache only
                    self.more, self.more_costs, new = np.zeros(0, np.uint32), np.zeros((0, len(self.costs))), own
                keys, costs = np.concatenate([self.more, new]), np.concatenate([self.more_costs, self.model.code_lengths(new)])
                order = np.argsort(keys)
                self.more, self.more_costs = keys[order], costs[order]
                at, _ = Model._find(self.more, own)
            doc = np.searchsorted(offs, miss, "right") - 1
            for j in range(len(self.costs)):
                out[:, j] += np.bincount(doc, self.more_costs[at, j][inv], len(out))
        return out


def gram_counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct fours, counts) of a block; a document longer than ``SLICE`` is counted slice by slice, each with the three bytes before it."""
    if len(data) <= SLICE or len(offs) > 2:
        yield np.unique(grams(data, offs)[0], return_counts=True)
        return
    for a in range(0, len(data), SLICE):
        part = data[max(a - 3, 0) : a + SLICE]
        yield np.unique(grams(part, np.array([0, len(part)]))[0][min(a, 3) :], return_counts=True)


class Counts:
    """Counts of fours by language, summed whenever as many as ``HELD`` more have come."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held, self.size = 0, 0

    def add(self, lang: str, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((keys, n.astype(np.int64)))
        self.held += len(keys)
        if self.held > self.size + HELD:
            self.sums()

    def sums(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        for lang, rows in self.parts.items():
            if len(rows) > 1:
                keys, inv = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, inv, np.concatenate([x for _, x in rows]))
                self.parts[lang] = [(keys, n)]
        self.held = self.size = sum(len(rows[0][0]) for rows in self.parts.values())
        return {lang: rows[0] for lang, rows in self.parts.items()}


def fit(labelled: DataFrame) -> Model | None:
    """A model from all rows (doc_id, text, lang).  Rows without text or lang don't count; None if none is left.

    Every byte of every language's text is counted, on the executors: a task sums its own rows, and the
    sums are dealt by the four bytes and summed again.  The driver gets each distinct four of a language
    once, whose number grows far slower than the text.
    """
    known = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text")
    buckets = B.partitions(labelled.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("blob", pa.binary())])

    def rows(counts: Counts) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in counts.sums().items():
            for k, i in B.split_by(B.mix(keys.astype(np.uint64)) % np.uint64(buckets)):
                yield B.row_batch(schema, bucket=[k], lang=[lang], blob=[B.pack(keys[i], n[i])])

    @B.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for lang in np.unique(names):
                part = batch.take(pa.array(np.flatnonzero(names == lang)))
                for _, _, data, offs in B.text_blocks(part):
                    for keys, n in gram_counts(data, offs):
                        counts.add(lang, keys, n)
            if counts.size > 2 * HELD:
                yield from rows(counts)
                counts = Counts()
        yield from rows(counts)

    @B.tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for lang, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts.add(lang, *B.unpack(blob, "u4", "i8"))
        for lang, (keys, n) in counts.sums().items():
            yield B.row_batch(schema, bucket=[0], lang=[lang], blob=[B.pack(keys, n)])

    kind = "bucket int, lang string, blob binary"
    found: dict[str, list] = {}
    for r in known.mapInArrow(count, kind).repartition(buckets, "bucket").mapInArrow(total, kind).collect():
        found.setdefault(r["lang"], []).append(B.unpack(bytes(r["blob"]), "u4", "i8"))
    if not found:
        return None
    langs = sorted(found)
    keys = np.unique(np.concatenate([k for rows in found.values() for k, _ in rows]))
    counts = np.zeros((len(keys), len(langs)))
    for j, lang in enumerate(langs):
        for k, n in found[lang]:
            counts[np.searchsorted(keys, k), j] += n
    return Model(langs, keys, counts)


def predict(docs: DataFrame, model: Model | None, keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte): the language with the shortest code, and its share of the posterior.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model.
    Ties go to the first language by name.  Whole texts are scored; rows are independent.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = "doc_id long, lang_pred string, score double, bits_per_byte double"
    if model is None:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        scorer = Scorer(sent.value)
        langs = np.array([*sent.value.langs, "und"], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for a, n, data, offs in B.text_blocks(batch, block_bytes=1 << 20):
                bits = scorer.bits(data, offs)
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                score = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
                ok = letters[a : a + n]
                yield B.row_batch(schema, doc_id=batch.column(0).slice(a, n), lang_pred=langs[np.where(ok, best, -1)].tolist(), score=np.where(ok, score, 0.0), bits_per_byte=least / np.maximum(np.diff(offs), 1))

    return src.mapInArrow(run, kind)
