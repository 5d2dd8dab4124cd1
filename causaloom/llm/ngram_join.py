"""N-gram Jaccard join by a token-group matrix.

Documents are sets of five-word shingles (64-bit hashes).  The components
are exact: two sets are in one if links of a Jaccard similarity of the threshold or more
connect them.  Only connectivity is computed: links inside a component beyond those that
connect it are not looked for, and no number of links is given.

1. Equal sets form a class; one row stands for a class, whatever its copies: tasks know the
   standing rows of the classes of most copies, and drop the copies of others that they meet.
2. Only tokens of several classes can be shared.  Tokens travel as packed arrays to hash
   ranges, which tell each class which of its tokens others have and how frequent they
   are.  A class whose shared tokens are fewer than any link needs is done.
3. In a common order of tokens, the rarest first, the first tokens of two sets that link
   have one in common (see :func:`first_tokens`).
4. Similar classes are partitioned into groups of bounded size: classes that agree in
   three min-hashes are compared with one of them, the hub, and verified links make
   components, which are cut into groups; the other classes are grouped by a min-hash.
5. The token-group matrix: groups that share no first token are never looked at, nor are
   two groups of one component.  For the others each query's overlap with the group's
   token union is counted, and a group is opened for the queries whose overlap reaches
   what a link with its members needs.  These are compared exactly, by packed arrays.
6. Components of all verified links.

Very frequent tokens (see ``HOT_SHARE``) stay out of the hash ranges: they are known to
be shared and come last in the common order, so that no range grows with a passage that
many documents hold.  A packed piece makes a row for each range that it meets, at most
one a token.  Classes that are similar but not linked are compared in blocks, so that
the work on a mass of such texts is quadratic in their number, with a small factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_binary, by_group, give_back, mix64, pieces, stored, word_hashes
from .components import components

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
MINHASHES = 6
#: Min-hashes that must agree for a comparison with a hub, and rounds of comparisons.
AGREEING, ROUNDS = 4, 2
#: One class in so many is looked at for very frequent tokens.
SAMPLED = 16
#: Tokens in more than one of so many sampled classes are very frequent; by that share a
#: list holds so many times a set's mean size at most.  The list is cut at its longest, 4 MB.
HOT_SHARE, HOT_MOST = 1024, 1 << 19
#: Tokens that a task packs at once, and about as many as a range gets.
PACKED = 2_000_000
#: Tokens that are given their range at a time.
SLICE = 1 << 16
#: Members of a group, and their shared tokens, unless a single member has more.
MEMBERS, MEMBER_TOKENS = 64, 32_000
#: Classes of most copies whose standing rows the tasks know, 2 MB.
COPIED_MOST = 1 << 16
_LAST = 255
#: Part of a packed row: a class, the size of its set, and how many of the row's tokens are its own.
_HEAD = np.dtype([("class", "<i8"), ("n", "<i4"), ("count", "<i4")])
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts give one hash of all their words."""
    h, lengths = word_hashes(texts)
    n = len(h)
    acc = np.zeros(max(0, n - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        acc = (acc ^ h[k : n - WIDTH + 1 + k]) * _M[k]
        acc ^= acc >> np.uint64(31)
    out, at = [], 0
    for m in lengths.tolist():
        if m >= WIDTH:
            s = np.sort(acc[at : at + m - WIDTH + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif m:
            a = np.uint64(m)
            for k in range(m):
                a = mix64(np.array([a ^ h[at + k]]))[0]
            out.append(np.array([a], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def _class_key(s: np.ndarray) -> int:
    m = mix64(s)
    return int(np.bitwise_xor.reduce(m) ^ mix64(np.array([m.sum(dtype=np.uint64) + np.uint64(len(s))]))[0]) & (2**64 - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def _heads(names: np.ndarray, ns: np.ndarray, count: np.ndarray) -> bytes:
    head = np.empty(len(names), _HEAD)
    head["class"], head["n"], head["count"] = names, ns, count
    return head.tobytes()


def needed(n: np.ndarray | int):
    """Least overlap of a set of n tokens with any set that it links to."""
    return -(-n * PERCENT // 100)


def profiles(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n, class), and beside them rows (token, seen) of frequent tokens of sampled classes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "text_key", "n", "class", "token", "seen"]

    def batch(ids, keys, ns, classes, tokens, seen):
        m, k = len(ns), len(tokens)
        return pa.RecordBatch.from_arrays([ids, keys, *[pa.array(c, t) for c, t in zip((ns, classes, [None] * m, [None] * m), kinds[2:], strict=True)]] if m else [pa.nulls(k, pa.int64())] * 4 + [pa.array(tokens), pa.array(seen)], names)

    def scan(batches):
        held, met, size = [], set(), 0

        def frequent():
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= 4
            return batch(None, None, (), (), token[often].view(np.int64), seen[often])

        for whole in batches:
            for part in pieces(whole, 1024, 1_000_000):
                ns, classes = [], []
                for s in shingle_sets(as_binary(part.column(2)).to_pylist()):
                    key = _class_key(s) if len(s) else None
                    ns.append(len(s))
                    classes.append(None if key is None else _signed(key))
                    if key is not None and key % SAMPLED == 0 and key not in met:
                        met.add(key)
                        held.append(s)
                        size += len(s)
                yield batch(part.column(0), part.column(1), ns, classes, (), ())
                if size >= PACKED:
                    yield frequent()
                    held, met, size = [], set(), 0
        if held:
            yield frequent()

    return docs.select("doc_id", "text_key", "text").mapInArrow(scan, "doc_id long, text_key long, n long, class long, token long, seen long")


def _hot_tokens(rows: DataFrame, classes: DataFrame) -> np.ndarray:
    """The very frequent tokens, sorted: at most ``HOT_MOST``.

    The list decides the way of a token and its place in the common order; what it
    overlooks costs time but no link.
    """
    sampled = classes.filter(F.pmod("class", F.lit(SAMPLED)) == 0).count()
    often = rows.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") * HOT_SHARE > sampled)
    return np.sort(np.array([r.token for r in often.orderBy(F.desc("seen"), "token").limit(HOT_MOST).collect()], np.int64).view(np.uint64))


def _among(tokens: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(tokens), bool)
    return listed[np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)] == tokens


def _ranges(tokens: np.ndarray, owner: np.ndarray, names: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token is very frequent, its range) of all tokens, made SLICE at a time; very frequent ones go by their class."""
    often, bucket = np.empty(len(tokens), bool), np.empty(len(tokens), np.uint16 if buckets <= 1 << 16 else np.int64)
    for at in range(0, len(tokens), SLICE):
        some = slice(at, at + SLICE)
        often[some] = _among(tokens[some], hot)
        bucket[some] = (mix64(np.where(often[some], names.view(np.uint64)[owner[some]], tokens[some])) >> np.uint64(32)).astype(np.int64) % buckets
    return often, bucket


def _packed(keys: np.ndarray, names: np.ndarray, ns: np.ndarray, owner: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """A row (key, (class, n, count), column...) for each run of ``keys``; owners are places in ``names`` and ``ns``, in order within a run."""
    cuts = _starts(keys)
    out = [[] for _ in range(2 + len(columns))]
    for lo, hi in zip(cuts, np.append(cuts, len(keys))[1:], strict=True):
        at = _starts(owner[lo:hi])
        own = owner[lo:hi][at]
        out[0].append(int(keys[lo]))
        out[1].append(_heads(names[own], ns[own], np.diff(np.append(at, hi - lo))))
        for k, c in enumerate(columns):
            out[2 + k].append(c[lo:hi].tobytes())
    return [pa.array(c, pa.int64() if not k else pa.binary()) for k, c in enumerate(out)]


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column without nulls, where they lie."""
    if not len(column):
        return np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def _unpacked(batches: list[pa.RecordBatch], first: int, *kinds: str) -> list[np.ndarray]:
    """(classes in order, their n, each token's place among them, column...) of packed rows."""
    read = lambda k, kind: np.concatenate([np.zeros(0, kind), *[_bytes_of(b.column(first + k)).view(kind) for b in batches]])
    head = read(0, _HEAD)
    names, at = np.unique(head["class"].astype(np.int64), return_inverse=True)
    ns = np.zeros(len(names), np.int64)
    ns[at] = head["n"]
    return [names, ns, np.repeat(at.astype(np.int32), head["count"]), *[read(1 + k, kind) for k, kind in enumerate(kinds)]]


def _chosen_rows(classes: DataFrame) -> dict[int, tuple]:
    """class -> (doc_id, text_key) of the row that stands for it, of the classes of most rows: at most ``COPIED_MOST``.

    Any other class has fewer rows than each of these; its copies are dropped by the
    tasks and ranges that meet them.
    """
    most = classes.filter(F.col("copies") >= 8).orderBy(F.desc("copies"), "class").limit(COPIED_MOST)
    return {r["class"]: (r.doc_id, r.text_key) for r in most.select("class", "least.doc_id", "least.text_key").collect()}


def shared_tokens(texts: DataFrame, hot: np.ndarray, chosen: dict[int, tuple], buckets: int) -> DataFrame:
    """(doc_id, text_key, text) -> (class, n, tokens, mins) of the classes that have enough tokens in common with others.

    ``tokens`` are those that several classes hold, in the common order: the rarest first
    (by powers of two, then by hash), the very frequent ones last.  ``mins`` are their
    min-hashes.
    """
    known = texts.sparkSession.sparkContext.broadcast((hot, chosen))

    def pack(batches):
        sets, size = {}, 0

        def flush():
            names, ns = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
            tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(ns), dtype=np.int32), ns)
            sets.clear()
            often, bucket = _ranges(tokens, owner, names, known.value[0], buckets)
            for flag in (False, True):
                ours = np.flatnonzero(often == flag)
                if len(ours):
                    ours = ours[np.argsort(bucket[ours], kind="stable")]  # owners stay in order
                    key, g, t = _packed(bucket[ours], names, ns, owner[ours], [tokens[ours].astype("<u8", copy=False)])
                    yield pa.RecordBatch.from_arrays([key, pa.array([flag] * len(key)), g, t], ["bucket", "often", "g", "t"])

        for whole in batches:
            for part in pieces(whole, 1024, 1_000_000):
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                for row, s in zip(rows, shingle_sets(as_binary(part.column(2)).to_pylist()), strict=True):
                    key = _signed(_class_key(s)) if len(s) else None
                    if key is not None and key not in sets and known.value[1].get(key, row) == row:
                        sets[key] = s
                        size += len(s)
                if size >= PACKED:
                    yield from flush()
                    size = 0
        if sets:
            yield from flush()
        give_back()

    def meet(key, batches):
        """Those tokens of the range that several classes hold, for ranges of the classes."""
        found, before = [], 0
        for flag in (False, True):
            names, ns, owner, tokens = _unpacked([b.filter(b.column(1)) if flag else b.filter(pc.invert(b.column(1))) for b in batches], 2, "<u8")
            order = np.lexsort((owner, tokens))
            owner, tokens = owner[order], tokens[order]
            once = _starts(tokens, owner)  # rows may be repeated
            del order
            if len(once) < len(tokens):
                owner, tokens = owner[once], tokens[once]
            del once
            count = np.diff(np.append(_starts(tokens), len(tokens)))
            rank = np.full(len(tokens), _LAST, np.uint8) if flag else np.repeat(np.log2(count).astype(np.uint8), count)
            keep = rank > 0
            found.append((names, ns, owner[keep] + np.int32(before), rank[keep], tokens[keep]))
            before = len(names)
        both, ns, owner, rank, tokens = (np.concatenate(c) for c in zip(*found, strict=True))
        del found
        to = ((mix64(both.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets).astype(np.int32)
        order = np.lexsort((both, to))
        place = np.empty(len(order), np.int32)  # a class may be there twice, with very frequent tokens and with others
        place[order] = np.cumsum(np.append(0, both[order][1:] != both[order][:-1])[: len(order)])
        first = _starts(place[order])
        names, ns, to, owner = both[order][first], ns[order][first], to[order][first], place[owner]
        order = np.argsort(owner, kind="stable")
        rank, tokens, owner = rank[order], tokens[order], owner[order]
        del order
        yield pa.RecordBatch.from_arrays(_packed(to[owner], names, ns, owner, [rank, tokens.astype("<u8", copy=False)]), ["bucket", "g", "r", "t"])

    def gather(key, batches):
        names, ns, owner, rank, tokens = _unpacked(batches, 1, "u1", "<u8")
        order = np.lexsort((tokens, rank, owner))
        del rank
        owner, tokens = owner[order], tokens[order]
        del order
        starts = _starts(owner)
        count = np.diff(np.append(starts, len(owner)))
        own = owner[starts]
        able = count >= needed(ns[own])
        tokens = tokens[np.repeat(able, count)]
        count, names, ns = count[able], names[own[able]], ns[own[able]]
        del owner
        offsets = np.append(0, np.cumsum(count))
        mins = np.array([np.minimum.reduceat(mix64(tokens ^ m) >> np.uint64(1), offsets[:-1]) if len(count) else [] for m in (_M[i % 5] + np.uint64(i) for i in range(MINHASHES))]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names), pa.array(ns), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * MINHASHES, pa.int32()), pa.array(mins.T.ravel())),
            ],
            ["class", "n", "tokens", "mins"],
        )

    told = texts.select("doc_id", "text_key", "text").mapInArrow(pack, "bucket long, often boolean, g binary, t binary")
    told = told.groupBy("bucket").applyInArrow(by_group(meet), "bucket long, g binary, r binary, t binary")
    return told.groupBy("bucket").applyInArrow(by_group(gather), "class long, n long, tokens array<long>, mins array<long>")


def first_tokens(n, shared):
    """(how many of its shared tokens a set of n must show, how many of them lead).

    Tokens that no other set has come first in the common order.  A link of sets a and b,
    n_a <= n_b, has an overlap of at least ``needed(n_b)`` and of 2 p / (100 + p) n_a
    (p the per cent): its first token in the common order is among the last
    ``needed`` ones of b counted from the end, and among the last 6 n / 7 of a.
    """
    up = (lambda x, d: F.ceil(x / d)) if isinstance(n, Column) else (lambda x, d: -(-x // d))
    return shared - up(n * PERCENT, 100) + 1, shared - up(n * 2 * PERCENT, 100 + PERCENT) + 1


def _sizes_fit(m, n):
    return (m * 100 >= n * PERCENT) & (n * 100 >= m * PERCENT)


def _linked(pairs: DataFrame, able: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact comparison."""
    a = able.select(F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    b = able.select(F.col("class").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return both.filter(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * PERCENT).select("a", "b")


def _hub_links(able: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(verified links, components of them): classes against the hub of every three min-hashes that they share."""
    links = roots = None
    threes = [(i, j, k) for i in range(MINHASHES) for j in range(i) for k in range(j)]
    keys = F.array(*[F.xxhash64(F.lit(x), *[F.col("mins")[i] for i in t]) for x, t in enumerate(threes)])
    mins = stored(able.select(F.col("class").alias("node"), "n", "mins", F.explode(keys).alias("key")), "keys")
    for turn in range(ROUNDS):
        known = mins if roots is None else mins.join(roots, "node", "left")
        known = known.withColumn("root", F.col("node") if roots is None else F.coalesce("root", "node"))
        order = F.struct(F.xxhash64(F.lit(turn), "root").alias("h"), F.col("root"), F.col("node"), F.col("n"), F.col("mins"))
        hubs = known.groupBy("key").agg(F.min(order).alias("hub"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key", "hub")
        agree = F.size(F.filter(F.zip_with("mins", "hub.mins", lambda x, y: x == y), lambda x: x))
        near = known.join(hubs, "key").filter((F.col("root") != F.col("hub.root")) & _sizes_fit(F.col("n"), F.col("hub.n")) & (agree >= AGREEING))
        # of the hubs of a class the one that agrees most, and the one that most classes of its kind choose
        near = near.groupBy("node").agg(F.max_by("hub.node", F.struct(agree, "hub.node")).alias("x"), F.min_by("hub.node", "hub").alias("y"))
        near = near.select("node", F.explode(F.array_distinct(F.array("x", "y"))).alias("hub"))
        more = stored(_linked(near.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), able), "links")
        if not more.limit(1).count():
            break
        links = more if links is None else links.union(more)
        roots = components(links)
    return links, roots


def _grouped(able: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(class, n, tokens, root, gid): components in parts of bounded size, other classes by a min-hash; their root is null."""
    rooted = able.withColumn("root", F.lit(None).cast("long")) if roots is None else able.join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = rooted.withColumn("near", F.when(F.col("root").isNull(), F.xxhash64(F.lit("s"), F.col("mins")[0])).otherwise(F.xxhash64(F.lit("r"), "root"))).select("class", "n", "tokens", "root", "near")
    parts = rooted.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(F.size("tokens")) / MEMBER_TOKENS)).alias("parts"))
    return rooted.join(parts, "near").withColumn("gid", F.xxhash64("near", F.pmod(F.xxhash64("class"), "parts"))).drop("near", "parts")


def _pairs_of_runs(runs: DataFrame) -> DataFrame:
    """(groups, leads) -> distinct pairs (g, h), g < h, of which one leads."""

    def scan(batches):
        for whole in batches:
            for part in pieces(whole):
                parts, size = [], 0
                for groups, leads in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    g, lead = np.array(groups, np.int64), np.array(leads, bool)
                    step = max(1, 500_000 // len(g))
                    for lo in range(0, len(g), step):
                        i, j = np.nonzero((np.arange(lo, min(lo + step, len(g)))[:, None] < np.arange(len(g))) & (lead[lo : lo + step, None] | lead))
                        parts.append(np.stack([g[i + lo], g[j]]))
                        size += len(i)
                        if size > 500_000:
                            parts = [np.unique(np.concatenate(parts, axis=1), axis=1)]
                            if (size := parts[0].shape[1]) > 250_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], ["g", "h"])
                                parts, size = [], 0
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(parts, axis=1), axis=1)], ["g", "h"])

    return runs.mapInArrow(scan, "g long, h long").distinct()


class Members:
    """Classes of a group: names, sizes, and their tokens one after the other."""

    def __init__(self, column: pa.Array, row: int):
        offsets = np.asarray(column.offsets)
        rows = column.values.slice(offsets[row], offsets[row + 1] - offsets[row])
        self.names, self.n = (np.asarray(rows.field(i), np.int64) for i in (0, 1))
        tokens = rows.field(2)
        ends = np.asarray(tokens.offsets)
        self.tokens = np.asarray(tokens.values, np.int64)[ends[0] : ends[-1]]
        self.count = np.diff(ends)
        self.owner = np.repeat(np.arange(len(self.n)), self.count)


def linked_members(q: Members, m: Members, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the members i of ``q`` and j of ``m`` that link; with ``same`` only i < j."""
    order = np.argsort(m.tokens, kind="stable")
    tokens, owner = m.tokens[order], m.owner[order]
    starts = _starts(tokens)
    union, times = tokens[starts], np.diff(np.append(starts, len(tokens)))
    at = np.minimum(np.searchsorted(union, q.tokens), len(union) - 1)
    hit = union[at] == q.tokens
    # the bound: overlap with the union against the least that a link with a member that fits needs
    least = np.maximum(m.n.min(), needed(q.n))
    opened = (np.bincount(q.owner[hit], minlength=len(q.n)) >= -(-(q.n + least) * PERCENT // (100 + PERCENT))) & (q.n * 100 >= m.n.min() * PERCENT) & (m.n.max() * 100 >= q.n * PERCENT)
    hit &= opened[q.owner]
    at, asker = at[hit], q.owner[hit]
    common = np.zeros(len(q.n) * len(m.n), np.int64)
    cost = np.cumsum(times[at])
    for lo in range(0, int(cost[-1]) if len(cost) else 0, 2_000_000):
        some = slice(*np.searchsorted(cost, [lo, lo + 2_000_000], side="right"))
        k = times[at[some]]
        each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[at[some]], k)
        common += np.bincount(np.repeat(asker[some], k) * len(m.n) + owner[each], minlength=len(common))
    common = common.reshape(len(q.n), len(m.n))
    i, j = np.nonzero(common * 100 >= (q.n[:, None] + m.n - common) * PERCENT)
    return (i[i < j], j[i < j]) if same else (i, j)


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that connect all that the links connect."""
    up, keep = {}, []

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            up[x] = y
            keep.append(k)
    return keep


def _group_links(grouped: DataFrame) -> DataFrame:
    """Links between classes of different groups, or of one group that is no part of a component."""
    members = F.collect_list(F.struct("class", "n", "tokens")).alias("members")
    matrix = stored(grouped.groupBy("gid").agg(F.first("root").alias("root"), F.min("n").alias("low"), F.max("n").alias("high"), members), "matrix")
    spans = matrix.select("gid", "root", "low", "high", F.size("members").alias("size"))
    show, lead = first_tokens(F.col("n"), F.size("tokens"))
    shown = grouped.select("gid", lead.alias("lead"), F.posexplode(F.slice("tokens", F.lit(1), show.cast("int"))).alias("pos", "token")).groupBy("token", "gid").agg(F.max(F.col("pos") < F.col("lead")).alias("leads"))
    runs = shown.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("gid", "leads"))).alias("run")).filter((F.size("run") > 1) & F.exists("run", lambda x: x["leads"]))
    pairs = _pairs_of_runs(runs.select("run").distinct().select(F.col("run.gid").alias("g"), F.col("run.leads").alias("l")))
    one = spans.select(*[F.col(c).alias(f"g{c}") for c in ("gid", "root", "low", "high")])
    two = spans.select(*[F.col(c).alias(f"h{c}") for c in ("gid", "root", "low", "high")])
    pairs = pairs.join(one, F.col("g") == F.col("ggid")).join(two, F.col("h") == F.col("hgid"))
    pairs = pairs.filter((F.col("glow") * PERCENT <= F.col("hhigh") * 100) & (F.col("hlow") * PERCENT <= F.col("ghigh") * 100) & ~F.coalesce(F.col("groot") == F.col("hroot"), F.lit(False)))
    own = spans.filter("root is null and size > 1").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    pairs = stored(pairs.select("g", "h").union(own), "pairs")

    def opened(batches):
        for batch in batches:
            same = np.asarray(batch.column(0).to_pylist(), bool)
            a, b = [], []
            for row in range(batch.num_rows):
                q, m = (Members(batch.column(k), row) for k in (1, 2))
                i, j = linked_members(q, m, same[row])
                keep = _spanning(q.names[i], m.names[j])
                a.append(q.names[i[keep]])
                b.append(m.names[j[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    one = matrix.select(F.col("gid").alias("g"), F.col("members").alias("queries"))
    two = matrix.select(F.col("gid").alias("h"), F.col("members").alias("group"))
    asked = pairs.join(one, "g").join(two, "h").select((F.col("g") == F.col("h")).alias("same"), "queries", "group")
    return stored(asked.mapInArrow(opened, "a long, b long"), "more_links", batch_rows=64)


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, component_id, kept) of every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id with the same set and ``component_id`` the
    smallest doc_id reachable by links.  ``kept`` marks the row of smallest doc_id (and
    then ``text_key``, a hash of the text) of each component; rows that agree in both are
    all marked.  Null, empty and wordless texts have an empty set and are linked with
    nothing: both ids are their own, and they are kept.  Rows with a null doc_id take part
    by their text, but name a class or component only if no row in it has an id (both ids
    are null then).  Rows with a repeated id are told apart by their texts.  Very long
    texts are compared whole.  An empty table gives no rows.  Other columns of ``docs`` do
    not matter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = stored(profiles(texts), "profiles")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))).alias("least")
    classes = stored(rows.filter("class is not null").groupBy("class").agg(least, F.first("n").alias("n"), F.count("*").alias("copies")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    chosen = _chosen_rows(classes)
    able = stored(shared_tokens(texts, _hot_tokens(rows, classes), chosen, int(max(12, total // PACKED))), "able")
    links, roots = _hub_links(able)
    more = _group_links(_grouped(able, roots))
    if more.limit(1).count():
        roots = components(more if links is None else links.union(more))
    known = classes.select("class", "least") if roots is None else classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("root", F.col("class") if roots is None else F.coalesce("root", "class"))
    best = known.groupBy("root").agg(F.min("least").alias("best"))
    known = known.join(best, "root").select("class", F.col("least.doc_id").alias("class_id"), "best")
    found = rows.filter("class is not null").join(known, "class").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class_id", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("kept"))
    alone = rows.filter("class is null and n is not null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(alone)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Component of every document under links of 75 % shingle similarity."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id")
