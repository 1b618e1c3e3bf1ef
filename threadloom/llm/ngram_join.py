"""Exact n-gram Jaccard join of documents, by set relations: links, and the classes they make.

A document is the set of its distinct five-word shingles.  Equal sets are one set with members.  All
sets share one order of shingles, rare before frequent by a count sketch of all documents, and a set of
n shingles need only be looked up by its first n - ceil(0.8 n) + 1 (its prefix).

Index level: an inverted list knows of each member its size, the shingle's position in it, how many of
its prefix shingles no other set's prefix has and where its prefix ends.  Blocks of a list, ordered by
size and position, are skipped as a whole where these can't give a link: two sets that share a shingle at
positions i and j share no more than min(i, j) before it and what the shorter rest leaves behind it.

Answer level: every set is first verified against one leader, the most typical member of the lists that
they share, which gives the leader's answers.  Classes are what is asked for, so pairs of one class need
no answer.  Of the others, a set's answers are derived from its leader's: sets that share x and y
shingles with a leader share x + y - |leader| at least and min(x, y) + min(what each has besides) at most,
which settles a pair either way; only pairs that this leaves open are verified by their shingles.  No
pair that could join two classes is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

SHINGLE, PERCENT = 5, 80
#: Input bytes of one bucket of shingles and of one task of what follows.
JOIN_BYTES = 8 << 20
#: Input bytes to a file of the tables between the stages.
FILE_BYTES = 64 << 20
#: Members of a leader, and of a part of a list, that one task takes at a time.
LEADER_ROWS, LIST_ROWS = 5_000, 4_096
#: Members of a block of a long list; lists up to SHORT_LIST are paired together, about PAIR_ROWS pairs at a time.
LIST_BLOCK, SHORT_LIST, PAIR_ROWS = 512, 64, 200_000
#: Bytes of sets that go on in one batch.
SEND_BYTES = 2 << 20
_ALT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted in each document; first of each document with the total last).

    Words are lower-cased A-Z and cut at ASCII white space.  A document of fewer than k words, but not
    none, has its whole sequence as its one shingle.
    """
    low = B.LOWER[data]
    starts, ends, first = B.word_spans(B.SPACE[data], offs)
    h = B.word_hashes(low, starts, ends)
    words = np.diff(first)
    g = B.gram_hashes(h, k)
    doc = B.owners(first)
    ok = first[doc[: len(g)] + 1] - np.arange(len(g)) >= k
    g, gd = g[ok], doc[: len(g)][ok]
    short = np.flatnonzero((words > 0) & (words < k))
    extra = np.array([B.gram_hashes(np.append(h[first[d] : first[d + 1]], np.uint64(words[d])), int(words[d]) + 1)[0] for d in short], np.uint64)
    g, gd = np.concatenate([g, extra]), np.concatenate([gd, short])
    order = np.lexsort((g, gd))
    g, gd = g[order], gd[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
    g, gd = g[new], gd[new]
    return g, np.searchsorted(gd, np.arange(len(offs)))


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of sets of n and m that links them: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def fingerprints(g: np.ndarray, first: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A hash of each document's set: the sum of its shingles' mixed hashes."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(g ^ salt), dtype=np.uint64)])
    return (run[first[1:]] - run[first[:-1]]).view(np.int64)


def signatures(docs: DataFrame, bits: int, k: int = SHINGLE) -> DataFrame:
    """A stored table of (doc_id, n, f1, f2) for documents, and of the tasks' sketch counts (bucket, blob) with null doc_id and n."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        for batch in batches:
            for a, n, data, offs in B.text_blocks(batch):
                g, first = shingle_sets(data, offs, k)
                if sketch is None:
                    sketch = np.zeros(1 << bits, np.uint32)
                own, count = np.unique((g >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                sketch[own] += count.astype(np.uint32)
                none = [None] * n
                yield B.row_batch(schema, doc_id=batch.column(0).slice(a, n), n=np.diff(first).astype(np.int32), f1=fingerprints(g, first), f2=fingerprints(g, first, _ALT), bucket=none, blob=none)
        if sketch is not None:
            wide = min(bits, 16)
            for j, part in enumerate(sketch.reshape(-1, 1 << wide)):
                at = np.flatnonzero(part)
                if len(at):
                    yield B.row_batch(schema, doc_id=[None], n=[None], f1=[None], f2=[None], bucket=[j], blob=[B.pack(at.astype(np.uint16), part[at])])

    return B.stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, f1 long, f2 long, bucket int, blob binary"), "join-signatures", B.bucket_count(docs))


def rarity(table: DataFrame, bits: int) -> np.ndarray:
    """The sketch's counts over all documents as 256 logarithmic classes; its size is fixed by ``bits``."""
    wide = min(bits, 16)

    @B.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = B.unpack(blob, "u2", "u4")
                total.setdefault(k, np.zeros(1 << wide, np.int64))[at] += n
        yield B.row_batch(pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]), bucket=list(total), blob=[np.minimum(8 * np.log2(x + 1), 255).astype(np.uint8).tobytes() for x in total.values()])

    out = np.zeros((1 << (bits - wide), 1 << wide), np.uint8)
    parts = table.where(F.col("bucket").isNotNull()).select("bucket", "blob").repartition(min(1 << (bits - wide), B.partitions(table.sparkSession)), "bucket")
    for r in parts.mapInArrow(add, "bucket int, blob binary").collect():
        out[r["bucket"]] = np.frombuffer(bytes(r["blob"]), np.uint8)
    return out.ravel()


def chosen_sets(batch: pa.RecordBatch, a: int, n: int, data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a block of (doc_id, text, only), without the rows whose set isn't the one that ``only`` names."""
    g, first = shingle_sets(data, offs, k)
    only = batch.column(2).slice(a, n)
    if only.null_count < n:
        out = (fingerprints(g, first) != only.fill_null(0).to_numpy(zero_copy_only=False)) & only.is_valid().to_numpy(zero_copy_only=False)
        size = np.diff(first)
        g, first = g[~np.repeat(out, size)], np.concatenate([[0], np.cumsum(np.where(out, 0, size))])
    return g, first


def prefix_entries(docs: DataFrame, classes: np.ndarray, bits: int, buckets: int, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, n, pos, last) for every prefix shingle that at least two sets' prefixes have.

    ``docs`` has (doc_id, text, only).  key and last are ranks in the common order, pos the shingle's place
    in its set.  Rows of one document give one set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("bucket", pa.int64()), ("entries", pa.binary()), ("sets", pa.binary())])
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("last", pa.int64())])

    @B.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            doc_ids = B.ids(batch)
            for a, n, data, offs in B.text_blocks(batch):
                g, first = chosen_sets(batch, a, n, data, offs, k)
                key = (table[(g >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (g & np.uint64((1 << 55) - 1))
                doc = B.owners(first)
                key = key[np.lexsort((key, doc))]
                size = np.diff(first)
                keep = np.where(size > 0, prefix_length(size, percent), 0)
                pos = np.arange(len(key)) - first[doc]
                at = pos < keep[doc]
                last = key[np.maximum(first[:-1] + keep - 1, 0)] if len(key) else np.zeros(n, np.uint64)
                key, doc, pos = key[at], doc[at], pos[at]
                bucket = (key & np.uint64((1 << 55) - 1)) % np.uint64(buckets)
                rows = []
                for b, i in B.split_by(bucket):
                    own, local = np.unique(doc[i], return_inverse=True)
                    rows.append((b, B.pack(key[i], local.astype(np.uint32), pos[i].astype(np.uint32)), B.pack(doc_ids[a : a + n][own], size[own].astype(np.uint32), last[own])))
                yield B.row_batch(schema, bucket=[r[0] for r in rows], entries=[r[1] for r in rows], sets=[r[2] for r in rows])

    @B.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in B.per_bucket(batches):
            parts = []
            for batch in bucket:
                for e, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    key, local, pos = B.unpack(e, "u8", "u4", "u4")
                    doc, n, last = B.unpack(s, "i8", "u4", "u8")
                    parts.append((key, doc[local], n[local], pos, last[local]))
            key, doc, n, pos, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.lexsort((doc, key))
            x, d = key[order], doc[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
            order, x = order[new], x[new]
            same = np.zeros(len(x) + 1, bool)
            same[1:-1] = x[1:] == x[:-1]
            order = order[same[1:] | same[:-1]]
            for a in range(0, len(order), 50_000):
                i = order[a : a + 50_000]
                yield B.row_batch(out, key=key[i].view(np.int64), doc_id=doc[i], n=n[i].astype(np.int32), pos=pos[i].astype(np.int32), last=last[i].view(np.int64))

    return B.gathered(docs.mapInArrow(send, "bucket long, entries binary, sets binary"), buckets).mapInArrow(meet, "key long, doc_id long, n int, pos int, last long")


def possible(n: np.ndarray, u: np.ndarray, last: np.ndarray, n2: np.ndarray, u2: np.ndarray, last2: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether two sets may be linked, from their sizes and the bound on their overlap.

    Of two sets, all prefix shingles of the one whose prefix ends first in the common order would, if
    shared, be in the other's prefix too; so its u unshared ones are not in the other set.
    """
    need = least_overlap(n, n2, percent)
    most = np.where(last < last2, n - u, np.where(last2 < last, n2 - u2, np.minimum(n - u, n2 - u2)))
    return (np.minimum(n, n2) >= need) & (most >= need)


def with_leaders(entries: DataFrame) -> DataFrame:
    """Adds to every list entry its list's leader: the member with the fewest unshared prefix shingles ``u`` (ties: the least id).

    Leaders are aggregated before the entries meet them, so no task needs a whole list.
    """
    least = entries.groupBy("key").agg(F.min(F.struct("u", "doc_id"))["doc_id"].alias("leader"))
    return entries.join(least, "key")


def leader_pairs(by_leader: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, leader): of the leaders of a set's lists that it may be linked to, the one it shares most lists with.

    ``by_leader`` has (doc_id, leader, n, last, u, s), s being the number of the set's lists with that leader.
    """
    led = by_leader.where("doc_id = leader").select("leader", F.col("n").alias("n2"), F.col("last").alias("last2"), F.col("u").alias("u2"))
    need = f"cast(ceil({percent} * (n + n2) / {100 + percent}D) as int)"
    most = "case when last < last2 then n - u when last2 < last then n2 - u2 else least(n - u, n2 - u2) end"
    pairs = by_leader.where("doc_id <> leader").join(led, "leader").where(f"least(n, n2) >= {need} and {most} >= {need}")
    return pairs.groupBy("doc_id").agg(F.max_by("leader", F.struct("s", -F.col("leader"))).alias("leader"))


def list_parts(lists: DataFrame, rows: int = LIST_ROWS) -> DataFrame:
    """The entries of lists with several classes, by part: adds bucket, a, b and own.

    A list of over ``rows`` members is dealt into parts of about as many, and a task pairs two parts (a, b)
    of it, so that a long list is the work of many tasks; a member goes to each task of its part ``own``.
    """
    mixed = lists.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("_n")).where("x < y")
    s = F.ceil(F.col("_n") / rows).cast("int")
    dealt = lists.join(mixed.select("key", s.alias("_s")), "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("_s")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return dealt.select("key", F.least("own", "_o").alias("a"), F.greatest("own", "_o").alias("b"), "own", *LISTED)


#: What a list says of a member, beside its key and parts.
LISTED = ["doc_id", "n", "pos", "last", "u", "comp", "leader", "s", "r", "main", "judge", "shares", "judge_n"]


def class_pairs(lists: DataFrame, tasks: int, percent: int = PERCENT) -> DataFrame:
    """(doc_id, leader, sure) pairs of different classes that may be linked, or surely are.

    A linked pair shares ``need`` prefix shingles at least.  Of a list with leader L, a set has s lists with
    that leader and r with others, so two sets share at most min(s, s') + min(r, r').  If all that they share
    is led by L, min(s, s') must reach ``need``.  If not, they meet in a list of another leader as well; so
    where L is the main leader of both, which is so in a long list of near copies, only the first case
    counts.  A set shares ``shares`` shingles with its judge, the leader that it was verified against, which
    has ``judge_n``: where two sets have one judge, that bounds what they share.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("leader", pa.int64()), ("c", pa.int32()), ("need", pa.int32()), ("sure", pa.bool_())])

    def kept_pairs(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The pairs of members p and q of one list, in order of size, that the bounds and the judges' answers leave."""
        n, doc, judge, shares, last = x["n"], x["doc_id"], x["judge"], x["shares"], x["last"]
        behind = n - prefix_length(n, percent)
        keep = possible(n[p], x["u"][p], last[p], n[q], x["u"][q], last[q], percent)
        p, q = p[keep], q[keep]
        need = least_overlap(n[p], n[q], percent)
        # What the judge's answers say.
        one = (judge[p] == judge[q]) & (judge[p] != NO_JUDGE)
        most = np.minimum(shares[p], shares[q]) + np.minimum(n[p] - shares[p], n[q] - shares[q])
        sure = one & (shares[p] + shares[q] - x["judge_n"][p] >= need)
        settled = one & (most < need) | (judge[p] == doc[q]) | (judge[q] == doc[p])
        p, q, need, sure = p[~settled], q[~settled], need[~settled], sure[~settled]
        # Behind its prefix a set has so many shingles; the set whose prefix ends first shares no others.
        rest = np.where(last[p] < last[q], behind[p], np.where(last[q] < last[p], behind[q], np.minimum(behind[p], behind[q])))
        need = need - rest
        led, other = np.minimum(x["s"][p], x["s"][q]), np.minimum(x["r"][p], x["r"][q])
        both_main = x["main"][p] & x["main"][q]
        keep = (led + other >= need) & ((led >= need) | ~both_main)
        p, q, need, other, sure, both_main = p[keep], q[keep], need[keep], other[keep], sure[keep], both_main[keep]
        return np.stack([np.minimum(doc[p], doc[q]), np.maximum(doc[p], doc[q]), x["leader"][p], np.where(both_main, need - other, 1), sure], 1)

    def by_position(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether members p and q (arrays that broadcast) of other classes and, in halves of a list, other parts may be linked by where they have the list's shingle."""
        n, pos = x["n"], x["pos"]
        most = np.minimum(pos[p], pos[q]) + 1 + np.minimum((n - 1 - pos)[p], (n - 1 - pos)[q])
        return (x["comp"][p] != x["comp"][q]) & (most >= least_overlap(n[p], n[q], percent)) & ((x["a"][p] == x["b"][p]) | (x["own"][p] != x["own"][q]))

    def of_long_list(x: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """The pairs of one list, by blocks of members in order of size and position."""
        n, pos, comp = x["n"], x["pos"], x["comp"]
        tail = n - 1 - pos
        for i in range(0, len(n), LIST_BLOCK):
            p = np.arange(i, min(i + LIST_BLOCK, len(n)))
            for j in range(i, len(n), LIST_BLOCK):
                q = np.arange(j, min(j + LIST_BLOCK, len(n)))
                if 100 * n[p[-1]] < percent * n[j]:
                    break  # all sets from here on are too large for this block's
                # The block as a whole: by position, and by class.
                most = min(pos[p].max(), pos[q].max()) + 1 + min(tail[p].max(), tail[q].max())
                if most < least_overlap(n[i], n[j], percent) or (comp[p] == comp[i]).all() and (comp[q] == comp[i]).all():
                    continue
                ok = by_position(x, p[:, None], q[None, :])
                s, t = np.nonzero(np.triu(ok, 1) if i == j else ok)
                yield kept_pairs(x, s + i, t + j)

    def of_short_lists(x: dict[str, np.ndarray], size: np.ndarray) -> Iterator[np.ndarray]:
        """The pairs of many lists of these sizes, all at once."""
        end = np.repeat(np.cumsum(size), size)
        partners = end - np.arange(len(end)) - 1
        upto = np.cumsum(partners)
        a = 0
        while a < len(end):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIR_ROWS, "right")))
            k = partners[a:b]
            p = np.repeat(np.arange(a, b), k)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
            ok = by_position(x, p, q)
            yield kept_pairs(x, p[ok], q[ok])
            a = b

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(kept)
            x = x[np.lexsort(x.T)]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]).any(1)
            at = np.flatnonzero(new)
            c = np.diff(np.append(at, len(x)))
            x = x[at]
            return B.row_batch(schema, a=x[:, 0], b=x[:, 1], leader=x[:, 2], c=c.astype(np.int32), need=x[:, 3].astype(np.int32), sure=x[:, 4].astype(bool))

        names = ["key", "a", "b", "own", *LISTED]

        def whole_lists() -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
            """Batches of whole lists (or parts), members in order of size and position, and the lists' sizes."""
            rest: dict[str, np.ndarray] | None = None
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    if not batch.num_rows:
                        continue
                    cols = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
                    if rest is not None:
                        cols = {c: np.concatenate([rest[c], v]) for c, v in cols.items()}
                elif rest is None:
                    return
                else:
                    cols = rest
                new = np.append(True, (cols["key"][1:] != cols["key"][:-1]) | (cols["a"][1:] != cols["a"][:-1]) | (cols["b"][1:] != cols["b"][:-1]))
                at = np.flatnonzero(new)
                upto = len(new) if batch is None else int(at[-1])
                rest = {c: v[upto:] for c, v in cols.items()}
                if upto:
                    order = np.lexsort((cols["doc_id"][:upto], cols["pos"][:upto], cols["n"][:upto], np.cumsum(new)[:upto]))
                    yield {c: v[:upto][order] for c, v in cols.items()}, np.diff(np.append(at[at < upto], upto))

        for x, size in whole_lists():
            short = np.repeat(size <= SHORT_LIST, size)
            found = [of_short_lists({c: v[short] for c, v in x.items()}, size[size <= SHORT_LIST])]
            begin = np.cumsum(size) - size
            found += [of_long_list({c: v[begin[i] : begin[i] + size[i]] for c, v in x.items()}) for i in np.flatnonzero(size > SHORT_LIST)]
            for part in itertools.chain(*found):
                if not len(part):
                    continue
                kept.append(part)
                count += len(part)
                if count > 200_000:
                    yield flush()
                    kept, count = [], 0
        if kept:
            yield flush()

    dealt = list_parts(lists).repartition(tasks, "key", "a", "b").sortWithinPartitions("key", "a", "b").select("key", "a", "b", "own", *LISTED)
    found = dealt.mapInArrow(run, "a long, b long, leader long, c int, need int, sure boolean").groupBy("a", "b", "leader").agg(F.sum("c").alias("c"), F.min("need").alias("need"), F.max("sure").alias("sure"))
    return found.where("sure or c >= need").groupBy("a", "b").agg(F.max("sure").alias("sure")).select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), "sure")


#: The judge of a set that none was verified against.
NO_JUDGE = -(1 << 63)


def verified(docs: DataFrame, pairs: DataFrame, tasks: int, k: int = SHINGLE, percent: int = PERCENT, leader_rows: int = LEADER_ROWS) -> DataFrame:
    """(leader, doc_id, leader_n, shares, linked) of the pairs (doc_id, leader), a stored table, by exact intersection.

    ``docs`` has (doc_id, text, only).  Texts of paired documents are cut into sets once more and meet at the
    leader; a leader of many members is sent to as many groups as those members need.
    """
    spark = docs.sparkSession
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], "leader long, doc_id long, leader_n long, shares long, linked boolean")
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / leader_rows).cast("int").alias("s"))
    spread = F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int")
    members = pairs.join(salts, "leader").select("doc_id", "leader", spread.alias("salt"))
    leads = salts.select(F.col("leader").alias("doc_id"), "leader", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
    roles = leads.unionByName(members).groupBy("doc_id").agg(F.collect_list(F.struct("leader", "salt")).alias("roles"))
    roles = roles.select(F.col("doc_id").alias("_id"), F.transform("roles", lambda r: r["leader"]).alias("leaders"), F.transform("roles", lambda r: r["salt"].cast("long")).alias("salts"))
    joined = docs.join(F.broadcast(roles) if 2 * n <= B.BROADCAST_ROWS else roles, docs["doc_id"] == roles["_id"]).select("doc_id", "text", "only", "leaders", "salts")
    schema = pa.schema([("leader", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])

    @B.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, leaders, at = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for a, m, data, offs in B.text_blocks(batch):
                g, first = chosen_sets(batch, a, m, data, offs, k)
                out: dict[str, list] = {f.name: [] for f in schema}
                size = 0
                for d in range(m):
                    blob = g[first[d] : first[d + 1]].tobytes()
                    for lead, salt in zip(leaders[a + d], at[a + d], strict=True) if blob else ():
                        for name, x in zip(out, (lead, salt, doc_ids[a + d], int(lead != doc_ids[a + d]), blob), strict=True):
                            out[name].append(x)
                        size += len(blob)
                        if size > SEND_BYTES:
                            yield B.row_batch(schema, **out)
                            out, size = {f.name: [] for f in schema}, 0
                yield B.row_batch(schema, **out)

    told = pa.schema([("leader", pa.int64()), ("doc_id", pa.int64()), ("leader_n", pa.int64()), ("shares", pa.int64()), ("linked", pa.bool_())])

    @B.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in told}
            ids_, kinds, leads_, blobs = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(4)
            for i, kind in enumerate(kinds):
                x = np.frombuffer(blobs[i].as_buffer(), np.uint64)
                if kind == 0:
                    lead, own = leads_[i], x.copy()
                elif lead == leads_[i]:
                    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    both = int((own[at] == x).sum())
                    linked = 100 * both >= percent * (len(own) + len(x) - both)
                    for name, v in zip(out, (lead, ids_[i], len(own), both, linked), strict=True):
                        out[name].append(v)
            yield B.row_batch(told, **out)

    met = joined.mapInArrow(send, "leader long, salt long, doc_id long, kind int, blob binary").repartition(tasks, "leader", "salt").sortWithinPartitions("leader", "salt", "kind")
    return met.mapInArrow(meet, "leader long, doc_id long, leader_n long, shares long, linked boolean")


def connected(links: DataFrame, files: int) -> DataFrame:
    """(node, comp) of every node of links (a, b) that isn't the least of its class; comp is the class's least id.

    Each round every node hooks to its least neighbour, chains are shortened by jumping, and links are
    contracted; links within a class vanish, so a round's work shrinks.  All of it stays distributed, and a
    node of very many links is one that Spark can split, as each join has one row a node on its other side.
    """
    edges, rounds = links, []
    while True:
        edges = B.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc-edges", files)
        if edges.isEmpty():
            break
        parent = edges.groupBy("hi").agg(F.min("lo").alias("lo"))
        for _ in range(2):
            up = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("top"))
            parent = parent.join(up, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo"))
        parent = B.stored(parent, "cc-parent", files)
        rounds.append(parent)
        ha, hb = parent.select("hi", F.col("lo").alias("a")), parent.select(F.col("hi").alias("lo"), F.col("lo").alias("b"))
        edges = edges.join(ha, "hi", "left").join(hb, "lo", "left").select(F.coalesce("a", "hi").alias("a"), F.coalesce("b", "lo").alias("b"))
    if not rounds:
        return links.sparkSession.createDataFrame([], "node long, comp long")
    label = rounds[0].select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
    for parent in rounds[1:]:
        # Who was hooked in a later round only, is new.
        known = label.join(parent.select(F.col("hi").alias("comp"), F.col("lo").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        label = known.unionByName(parent.join(label.select(F.col("node").alias("hi")), "hi", "left_anti").select(F.col("hi").alias("node"), F.col("lo").alias("comp")))
    return B.stored(label, "cc-labels", files)


def _left_hot(left: DataFrame, right: DataFrame, on: list[str], value: str, hot: DataFrame) -> DataFrame:
    """left join of ``value``; the few keys in ``hot``, which very many rows have, are joined by broadcast, so no task gets all rows of one."""
    few = F.broadcast(hot.join(right, on).select(*on, F.col(value).alias("_v"), F.lit(True).alias("_hot")))
    x = left.join(few, on, "left")
    done = x.where("_hot").select(*left.columns, F.col("_v").alias(value))
    return done.unionByName(x.where("_hot is null").drop("_v", "_hot").join(right, on, "left").select(*left.columns, value))


def components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the least doc_id reachable by links.

    Null and empty texts have no shingles and are linked with nothing.  Equal sets are linked.  A null id
    keeps its row with itself (null) as its class.  Rows of one id come out once each, with their own
    n_shingles and one class, that of the row with the most shingles (ties: by hash).
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    size = B.input_bytes(src)
    bits = int(np.clip(np.ceil(np.log2(max(size, 1) / 512)), 12, 24))
    buckets = max(16, size // JOIN_BYTES)
    tasks = min(buckets, B.MOST_PARTITIONS)
    # Tables between the stages are small beside the documents, and so are written as few files.
    files = max(2, size // FILE_BYTES)
    table = signatures(src, bits, k)
    sigs = table.where(F.col("n").isNotNull()).select("doc_id", "n", "f1", "f2")
    real = sigs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    print_ = ["f1", "f2", "n"]
    one = real.groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("t"), F.min("f1").alias("x"), F.max("f1").alias("y")).select("doc_id", "t.*", "x", "y")
    equal = B.stored(one.groupBy(*print_).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1"), "join-equal", files)
    # Sets with a share of all documents: there are at most 100,000.
    often = max(1_000, sigs.count() // 100_000)
    hot = equal.where(F.col("m") > often)
    copies = _left_hot(one.select("doc_id", *print_), equal.select(*print_, "rep"), print_, "rep", hot.select(*print_))
    copies = B.stored(copies.where("doc_id <> rep").select("doc_id", "rep"), "join-copies", files)
    less = copies.select("doc_id")
    reps = src.where(F.col("doc_id").isNotNull()).join(F.broadcast(less) if copies.count() <= B.BROADCAST_ROWS else less, "doc_id", "left_anti")
    clash = one.where("x <> y").select(F.col("doc_id"), F.col("f1").alias("only"))
    if clash.isEmpty():
        reps = reps.withColumn("only", F.lit(None).cast("long"))
    else:
        clash = B.stored(clash, "join-clash", files)
        reps = reps.join(F.broadcast(clash) if clash.count() <= B.BROADCAST_ROWS else clash, "doc_id", "left")
    entries = B.stored(prefix_entries(reps, rarity(table, bits), bits, buckets, k, percent), "join-entries", files)
    classes = _classes(reps, entries, tasks, files, k, percent)
    own = sigs.join(copies, "doc_id", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    out = _left_hot(own, classes, ["rep"], "comp", hot.select("rep"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))


def _classes(reps: DataFrame, entries: DataFrame, tasks: int, files: int, k: int, percent: int) -> DataFrame:
    """(rep, comp) of the sets that aren't the least of their classes, from one row a set (doc_id, text, only) and the prefix entries."""
    shared = entries.groupBy("doc_id", "n").agg(F.count("*").alias("s"))
    need = F.expr(f"n - cast(ceil({percent} * n / 100.0D) as int) + 1 - s")
    full = B.stored(with_leaders(entries.join(shared.select("doc_id", need.cast("int").alias("u")), "doc_id")), "join-lists", files)
    by_leader = B.stored(full.groupBy("doc_id", "leader", "n", "last", "u").agg(F.count("*").cast("int").alias("s")), "join-leaders", files)
    answers = B.stored(verified(reps, B.stored(leader_pairs(by_leader, percent), "join-pairs", files), tasks, k, percent), "join-answers", files)
    label = connected(answers.where("linked").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), files)
    total = by_leader.groupBy("doc_id").agg(F.sum("s").cast("int").alias("t"), F.max_by("leader", F.struct("s", -F.col("leader"))).alias("top"))
    judged = answers.groupBy("doc_id").agg(F.max("leader").alias("judge"), F.max("shares").alias("shares"), F.max("leader_n").alias("judge_n"))
    sets = by_leader.join(total, "doc_id").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(judged, "doc_id", "left")
    sets = sets.select(
        "doc_id", "leader", F.coalesce("comp", "doc_id").alias("comp"), "s", (F.col("t") - F.col("s")).alias("r"), (F.col("leader") == F.col("top")).alias("main"),
        F.coalesce("judge", F.lit(NO_JUDGE)).alias("judge"), F.coalesce("shares", F.lit(0)).alias("shares"), F.coalesce("judge_n", F.lit(0)).alias("judge_n"),
    )
    open_ = B.stored(class_pairs(full.join(sets, ["doc_id", "leader"]), tasks, percent), "join-pairs", files)
    more = verified(reps, open_.where("not sure"), tasks, k, percent).where("linked").select("leader", "doc_id").unionByName(open_.where("sure").select("leader", "doc_id"))
    of = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    between = more.join(of("leader"), "leader", "left").join(of("doc_id"), "doc_id", "left").select(F.coalesce("_leader", "leader").alias("a"), F.coalesce("_doc_id", "doc_id").alias("b"))
    upper = connected(between, files).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    # A set has a label of its own, that of its class, or both.
    both = label.join(upper, "comp", "left").select(F.col("node").alias("rep"), F.coalesce("top", "comp").alias("comp"))
    return both.unionByName(upper.select(F.col("comp").alias("rep"), F.col("top").alias("comp")))
