"""Shingles, min-hash signatures, banded candidates and clusters."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import give_back, once_by_column, settings, spread

SHINGLE_WORDS, PERMUTATIONS, THRESHOLD = 5, 128, 0.8


def shingles(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, set): distinct hashes of k-word shingles; shorter texts give one, empty texts none."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    # shifted copies side by side: a slice inside a lambda would split the text again for every word
    shifted = [F.slice(words, i + 1, F.greatest(F.lit(1), F.size(words))) for i in range(k)]
    rows = F.slice(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)]), 1, F.greatest(F.lit(1), F.size(words) - (k - 1)))
    each = F.transform(rows, lambda r: F.xxhash64(F.concat_ws(" ", *[r[f"w{i}"] for i in range(k)])))
    return docs.select("doc_id", F.array_distinct(each).alias("set"), F.size(words).alias("n_words")).filter("n_words > 0").select("doc_id", "set")


#: Tokens that are hashed at a time, so that the numbers in hand stay in a core's cache.
TOKENS = 256
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def minima(tokens: np.ndarray, permutations: int) -> np.ndarray:
    """The least ``xxhash64(p, token)`` over the tokens (int64, one at least) for every p, as Spark computes it."""
    p = np.arange(permutations, dtype=np.uint64)
    seeds = _finished(_turned((np.uint64(42) + _P5 + np.uint64(4)) ^ p * _P1, 23) * _P2 + _P3)[:, None] + _P5 + np.uint64(8)
    least = np.full(permutations, np.iinfo(np.int64).max)
    for at in range(0, len(tokens), TOKENS):
        own = _turned(tokens[at : at + TOKENS].view(np.uint64) * _P2, 31) * _P1
        np.minimum(least, _finished(_turned(seeds ^ own, 27) * _P1 + _P4).view(np.int64).min(axis=1), out=least)
    return least


def signatures(sets: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, sig): minima of ``permutations`` hashes over the set.

    They are taken row by row before the shuffle; rows of one id are one document.
    """

    def of_rows(batches):
        for batch in batches:
            rows = batch.column(1)
            ends, tokens = np.asarray(rows.offsets), np.asarray(rows.values)
            found = [minima(tokens[a:b], permutations) for a, b in zip(ends, ends[1:], strict=False)]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, permutations), pa.int32()), flat)], ["doc_id", "sig"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    each = sets.select("doc_id", "set").mapInArrow(of_rows, f"doc_id {kind}, sig array<long>")
    return each.groupBy("doc_id").agg(*[F.min(F.col("sig")[p]).alias(f"h{p}") for p in range(permutations)]).select("doc_id", F.array(*[f"h{p}" for p in range(permutations)]).alias("sig"))


def band_shape(permutations: int = PERMUTATIONS, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bands, rows) whose collision curve has the least area of false candidates and misses around the threshold."""
    best = None
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        steps = [i / 200 for i in range(201)]
        hit = [1 - (1 - s**rows) ** bands for s in steps]
        cost = sum(h for s, h in zip(steps, hit, strict=True) if s < threshold) + sum(1 - h for s, h in zip(steps, hit, strict=True) if s >= threshold)
        if best is None or cost < best[0]:
            best = (cost, bands, rows)
    return best[1], best[2]


def candidate_stars(sigs: DataFrame, permutations: int = PERMUTATIONS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): every document with the first one of each band bucket; the closure equals that of all pairs."""
    bands, rows = band_shape(permutations, threshold)
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("sig")[i * rows + j] for j in range(rows)]) for i in range(bands)])
    banded = sigs.select("doc_id", F.explode(keys).alias("key"))
    hubs = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return banded.join(hubs, "key").filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicate_clusters(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, verify: bool = False) -> DataFrame:
    """(doc_id, cluster): candidates united without check, as the batch deduper does; with ``verify`` only
    candidates whose exact Jaccard similarity reaches the threshold."""
    sets = shingles(spread(docs.select("doc_id", "text")))
    edges = candidate_stars(signatures(sets, permutations), permutations, threshold)
    if verify:
        a, b = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        edges = edges.join(a, "a").join(b, "b").filter(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    roots = connected_components(edges)
    return docs.select("doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("cluster"))


#: Shingles that prefixes leave to the end, at most, and in how many prefixes one is found for that.
FREQUENT, OFTEN = 1 << 19, 10
#: Parts that rows of prefixes are dealt to, and rows of prefixes that a task packs at a time.
PARTS, PACKED = 4096, 250_000
#: Pairs of rows that are looked at, at a time.
LOOKED_AT = 300_000
#: Sets, and shingles, of a block whose pairs are compared together.
BLOCK_SETS, BLOCK_TOKENS = 1000, 1 << 19
#: Sets are moved in rounds, each of about a quarter of as many as there are classes, and at most so many rounds, for each reads all texts.
PARTS_OF_SETS, ROUNDS = 4, 16
#: While pairs are looked for, shuffle files go when the query that wrote them ends, and few texts are handed to Python at a time.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def _keys(ends: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its tokens (one at least)."""
    sums = np.add.reduceat(_finished(tokens.view(np.uint64) * _P1 + _P5), ends[:-1])
    return _finished(sums + np.diff(ends).astype(np.uint64) * _P4).view(np.int64)


def _prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _prefix(tokens: np.ndarray, ranks: np.ndarray | None, most: int) -> np.ndarray:
    """The first ``most`` of the ascending tokens in the order of their ranks, then values; most have rank 0."""
    if ranks is None or not ranks.any():
        return tokens[:most]
    plain = tokens[ranks == 0][:most]
    if len(plain) == most:
        return plain
    last = np.flatnonzero(ranks)
    return np.concatenate([plain, tokens[last[np.argsort(ranks[last])]][: most - len(plain)]])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True  # the white space of \s
_BYTES = _finished(np.arange(1, 257, dtype=np.uint64) * _P1)
#: Bytes of text that are hashed at a time.
PIECE = 1_000_000


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of the texts, number of words of each text): a word is the sum of random numbers of its
    bytes, each times an odd random number of its place, scrambled with its size."""
    data = np.frombuffer(b"".join([t + b" " for t in texts]), np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lengths = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), lengths
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    factors = _finished(np.arange(1, sizes.max() + 1, dtype=np.uint64) * _P3) | np.uint64(1)
    sums = np.add.reduceat(_BYTES[data[~_SPACE[data]]] * factors[place], first)
    return _finished(sums ^ sizes.astype(np.uint64) << np.uint64(40)), lengths


def shingle_sets(texts: list[bytes], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Ascending distinct hashes (int64) of the k-word shingles of lower-cased texts; shorter texts give one, empty texts none."""
    words, lengths = _word_hashes(texts)
    rows = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for at in range(k):
        rows = _finished((rows ^ words[at : at + len(rows)]) * _P1 + _P4)
    out, start = [], 0
    for m in lengths.tolist():
        own = rows[start : start + m - k + 1] if m >= k else np.zeros(min(m, 1), np.uint64)
        if 0 < m < k:
            for at in range(m):
                own = _finished((own ^ words[start + at]) * _P2 + np.uint64(m))
        own = np.sort(own.view(np.int64))
        out.append(own[np.append(True, own[1:] != own[:-1])] if m else own)
        start += m
    return out


def _sets(batches, among: np.ndarray | None = None):
    """(ids, ends, tokens) of texts with a word, from Arrow batches (doc_id, lower-cased text and, if only those in the filter ``among``
    are wanted, slot); the tokens of one end where the next begin."""
    for batch in batches:
        if among is not None:
            batch = batch.filter(pa.array(_in_filter(batch.column(2).to_numpy(), among)))
        step = max(1, int(batch.num_rows * PIECE / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            found = shingle_sets([t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()])
            sizes = np.array([len(x) for x in found])
            if sizes.any():
                yield part.column(0).filter(pa.array(sizes > 0)), np.append(0, np.cumsum(sizes[sizes > 0])), np.concatenate(found)


def _id_type(texts: DataFrame) -> str:
    return texts.schema["doc_id"].dataType.simpleString()


def _class_keys(texts: DataFrame) -> DataFrame:
    """(doc_id, key) of documents with a word."""

    def of_rows(batches):
        for ids, ends, tokens in _sets(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(_keys(ends, tokens))], ["doc_id", "key"])
        give_back()

    return texts.mapInArrow(of_rows, f"doc_id {_id_type(texts)}, key long")


def _slots_filter(slots: DataFrame, bits: int) -> np.ndarray:
    """The numbers in ``slot``, under ``bits``, as a filter of so many bits."""
    slot = F.col("slot")
    words = slots.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _in_filter(slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bits[slots >> 6] >> (slots & 63) & 1 == 1


def _filter_bits(n: int) -> int:
    """A power of two that gives ``n`` entries few false hits."""
    return 1 << min(29, max(20, (16 * n).bit_length()))


def _among(texts: DataFrame, ids: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(``texts`` with the slot of each document, the filter for ``_sets``): passes all documents of ``ids``, about ``n``, and some others."""
    bits = _filter_bits(n)
    slot = F.xxhash64("doc_id").bitwiseAND(bits - 1).alias("slot")
    return texts.select("doc_id", "text", slot), _slots_filter(ids.select(slot), bits)


def _ids(tokens: np.ndarray) -> np.ndarray:
    """The first 40 bits of tokens, in the same order: what prefixes are matched by.  Equal ones of unequal tokens only make work."""
    return (tokens.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(24)


def _token_of(ids: np.ndarray) -> np.ndarray:
    """The least token of each id."""
    return (ids << np.uint64(24) ^ np.uint64(1 << 63)).view(np.int64)


def _ranking(frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending ids of the tokens ``frequent``, the place of each there from 1)."""
    ids = _ids(frequent)
    order = np.argsort(ids)
    return ids[order], (order + 1).astype(np.int32)


def _prefixes(batches, threshold: float, ranking: tuple[np.ndarray, np.ndarray], among: np.ndarray | None = None):
    """(keys, sizes of sets, positions in the prefixes, sizes of prefixes, tokens of the prefixes one after the other) of the documents in the filter ``among``;
    ranked tokens are left to the end."""
    ascending, ranks = ranking
    for _, ends, tokens in _sets(batches, among):
        n, own = np.diff(ends), None
        if len(ascending):
            ids = _ids(tokens)
            at = np.minimum(np.searchsorted(ascending, ids), len(ascending) - 1)
            own = np.where(ascending[at] == ids, ranks[at], 0)
        parts = [_prefix(tokens[x:y], None if own is None else own[x:y], m) for x, y, m in zip(ends, ends[1:], _prefix_sizes(n, threshold), strict=False)]
        sizes = np.array([len(x) for x in parts])
        yield _keys(ends, tokens), n, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes, np.concatenate(parts)


def _prefix_rows(texts: DataFrame, threshold: float, frequent: np.ndarray) -> DataFrame:
    """(token, key, place) of prefixes that leave the ``frequent`` tokens, by rising frequency, to the end, as rows: all that
    :func:`_shared_rows` chooses from.  A place is the size of the set times two to the 32nd and the position."""
    ranking = _ranking(frequent)

    def of_rows(batches):
        for keys, n, position, sizes, tokens in _prefixes(batches, threshold, ranking):
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(keys, sizes)), pa.array(np.repeat(n << 32, sizes) | position)], ["token", "key", "place"])

    return texts.mapInArrow(of_rows, "token long, key long, place long")


def _packed(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """The low bytes of 64-bit numbers, all first ones, all second ones and so on, as they compress best."""
    return b"".join(c.view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True))


def _unpacked_rows(blobs: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    each = sum(widths)
    rows = [len(x) // each for x in blobs]
    out = [np.zeros((sum(rows), 8), np.uint8) for _ in widths]
    start = 0
    for blob, m in zip(blobs, rows, strict=True):
        planes, at = np.frombuffer(blob, np.uint8).reshape(each, m), 0
        for c, w in zip(out, widths, strict=True):
            c[start : start + m, :w] = planes[at : at + w].T
            at += w
        start += m
    return [c.reshape(-1).view(np.uint64) for c in out]


def _dealt(columns: list[np.ndarray], widths: tuple[int, ...]):
    """(part, packed rows) by a hash of the first column."""
    part = (_finished(columns[0] * _P2) & np.uint64(PARTS - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    columns, ends = [c[order] for c in columns], np.searchsorted(part[order], np.arange(PARTS + 1))
    some = np.flatnonzero(np.diff(ends))
    blobs = [_packed([c[ends[k] : ends[k + 1]] for c in columns], widths) for k in some]
    for at in range(0, len(some), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 1024].astype(np.int32)), pa.array(blobs[at : at + 1024], pa.binary())], ["part", "rows"])


_COUNTED, _ROWS = (5, 4), (5, 5, 5, 5, 8, 4, 4)


def _held(texts: DataFrame, threshold: float, frequent: np.ndarray, among: np.ndarray, least: int) -> DataFrame:
    """(token, n) of the ids that ``least`` prefixes or more hold, each by its least token."""
    ranking = _ranking(frequent)

    def counted(ids: list[np.ndarray]):
        return _dealt([x.astype(np.uint64) for x in np.unique(np.concatenate(ids), return_counts=True)], _COUNTED)

    def of_rows(batches):
        held, size = [], 0
        for *_, tokens in _prefixes(batches, threshold, ranking, among):
            held.append(_ids(tokens))
            size += len(tokens)
            if size >= PACKED:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)
        del held
        give_back()

    def summed(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if blobs:
            ids, n = _unpacked_rows(blobs, _COUNTED)
            order = np.argsort(ids)
            starts = np.flatnonzero(np.diff(ids[order], prepend=np.uint64(1 << 63)))
            n, ids = np.add.reduceat(n[order], starts), ids[order][starts]
            some = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(_token_of(ids[some])), pa.array(n[some].view(np.int64))], ["token", "n"])
            del blobs, ids, n, order, starts, some
        give_back()

    return texts.mapInArrow(of_rows, "part int, rows binary").repartition("part").mapInArrow(summed, "token long, n long")


def _id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_finished(ids * _P5 + _P1) & np.uint64(bits - 1)).astype(np.int64)


#: Stands for no id.
_NONE = np.uint64((1 << 40) - 1)


def _met_before(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of the ids of its document before each id: the last one and those of the least of two hashes; two documents that agree in any have met there."""
    out = [np.full(len(ids), _NONE) for _ in range(3)]
    hashes = [_finished(ids * p + _P1) for p in (_P3, _P4)]
    for x, y in zip(ends, ends[1:], strict=False):
        if y - x > 1:
            out[0][x + 1 : y] = ids[x : y - 1]
            for h, least in zip(hashes, out[1:], strict=True):
                own = h[x : y - 1]
                least[x + 1 : y] = ids[x : y - 1][np.maximum.accumulate(np.where(own == np.minimum.accumulate(own), np.arange(len(own)), 0))]
    return out


def _shared_rows(texts: DataFrame, threshold: float, frequent: np.ndarray, among: np.ndarray, shared: np.ndarray) -> DataFrame:
    """(part, rows): packed id, three ids before it (:func:`_met_before`), key, position in the prefix and size of the set for all ids of prefixes in the filter ``shared``."""
    ranking = _ranking(frequent)

    def of_rows(batches):
        held, size = [], 0
        for keys, n, position, sizes, tokens in _prefixes(batches, threshold, ranking, among):
            ids = _ids(tokens)
            some = _in_filter(_id_slots(ids, 64 * len(shared)), shared)
            document = np.repeat(np.arange(len(n)), sizes)[some]
            ids = ids[some]
            ends = np.searchsorted(document, np.arange(len(n) + 1))
            held.append([ids, *_met_before(ids, ends), keys.view(np.uint64)[document], position[some].astype(np.uint64), n[document].astype(np.uint64)])
            size += len(ids)
            if size >= PACKED:
                yield from _dealt([np.concatenate(x) for x in zip(*held, strict=True)], _ROWS)
                held, size = [], 0
        if size:
            yield from _dealt([np.concatenate(x) for x in zip(*held, strict=True)], _ROWS)
        del held
        give_back()

    return texts.mapInArrow(of_rows, "part int, rows binary")


def _meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """(ka, kb, sizes, places) of pairs of keys, ka < kb, that meet at an id and for all that the two rows tell have not met before:
    the first meeting is always among them.  Sizes and places are two numbers of 32 bits."""

    def pairs_of(blobs):
        ids, *before, keys, place, n = _unpacked_rows(blobs, _ROWS)
        order = np.lexsort((n, ids))
        ids, keys, place, n, *before = (x[order] for x in (ids, keys.view(np.int64), place.view(np.int64), n.view(np.int64), *before))
        group = np.cumsum(np.append(False, ids[1:] != ids[:-1])) if len(ids) else ids.astype(np.int64)
        # of the rows of an id, by rising size, those behind a row that are not too large
        last = np.searchsorted(group << 32 | n, group << 32 | np.floor(n / threshold + 1e-6).astype(np.int64), "right")
        count = last - np.arange(len(ids)) - 1
        start, total = 0, np.cumsum(count)
        while start < len(ids):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + LOOKED_AT, "right")))
            c = count[start:stop]
            a = np.repeat(np.arange(start, stop), c)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            start = stop
            need = threshold / (1 + threshold) * (n[a] + n[b]) - 1e-6
            new = (keys[a] != keys[b]) & (np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b]) >= need)
            for x in before:
                a, b = a[new], b[new]
                new = (x[a] != x[b]) | (x[a] == _NONE)
            a, b = a[new], b[new]
            turn = keys[a] > keys[b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[a], keys[b], n[a] << 32 | n[b], place[a] << 32 | place[b])], ["ka", "kb", "sizes", "places"])

    def of_rows(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if blobs:
            yield from pairs_of(blobs)
        del blobs
        give_back()

    return rows.repartition("part").mapInArrow(of_rows, "ka long, kb long, sizes long, places long")


def _sets_of(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, set) of documents among ``ids``, about ``n``, and of some others."""
    texts, among = _among(texts, ids, n)

    def of_rows(batches):
        for found, ends, tokens in _sets(batches, among):
            yield pa.RecordBatch.from_arrays([found, pa.array(_keys(ends, tokens)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))], ["doc_id", "key", "set"])
        give_back()

    return texts.mapInArrow(of_rows, f"doc_id {_id_type(texts)}, key long, set array<long>")


_LOW = (1 << 32) - 1


def _unpacked(both: str, name: str) -> list:
    """The two numbers of 32 bits in ``both``, as ``name`` a and b."""
    return [F.shiftright(both, 32).alias(f"{name}a"), F.col(both).bitwiseAND(_LOW).alias(f"{name}b")]


def _blocks(pairs: DataFrame) -> DataFrame:
    """(key, block) of all keys in (ka, kb, na, nb): a block is of bounded size and holds keys that have the same partner of most pairs."""
    ends = once_by_column(pairs.select(F.col("ka").alias("key"), F.col("na").alias("n")).union(pairs.select("kb", "nb")).groupBy("key").agg(F.count("*").alias("pairs"), F.first("n").alias("n")))
    a, b = (ends.select(F.col("key").alias(f"k{x}"), F.struct("pairs", "key").alias(f"most_{x}")) for x in "ab")
    both = pairs.select("ka", "kb").join(a, "ka").join(b, "kb")
    most = both.select(F.col("ka").alias("key"), F.col("most_b").alias("most")).union(both.select("kb", "most_a")).groupBy("key").agg(F.max("most").alias("most"))
    hubs = once_by_column(ends.join(most, "key").select("key", "n", F.greatest("most", F.struct("pairs", "key"))["key"].alias("hub")))
    sizes = hubs.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    return hubs.join(sizes, "hub").select("key", F.xxhash64("hub", F.pmod(F.xxhash64("key"), "parts")).alias("block"))


def _compared(sets: pa.Table, pairs: pa.Table, threshold: float) -> pa.Table:
    """(ka, kb, jaccard) of pairs at or above the threshold; sets are (key, set)."""
    keys, lists = sets.column("key").to_numpy(), sets.column("set").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    order, ends = np.argsort(keys), np.asarray(lists.offsets)
    words, tokens = np.unique(np.asarray(lists.values)[ends[0] : ends[-1]], return_inverse=True)
    ends, ascending = ends - ends[0], keys[order]
    n = np.diff(ends)
    a, b = (order[np.searchsorted(ascending, pairs.column(k).to_numpy())] for k in ("ka", "kb"))
    by = np.argsort(a, kind="stable")
    common, own = np.zeros(len(a), np.int64), np.zeros(len(words), np.int32)
    for rows in np.split(by, np.flatnonzero(np.diff(a[by])) + 1) if len(a) else []:
        mine = tokens[ends[a[rows[0]]] : ends[a[rows[0]] + 1]]
        own[mine] = 1
        if 4 * n[b[rows]].sum() > len(tokens):
            common[rows] = np.add.reduceat(own[tokens], ends[:-1])[b[rows]]
        else:
            common[rows] = [own[tokens[ends[k] : ends[k + 1]]].sum() for k in b[rows]]
        own[mine] = 0
    jaccard = common / (n[a] + n[b] - common)
    return pa.table({"ka": pairs.column("ka"), "kb": pairs.column("kb"), "jaccard": jaccard}).filter(pa.array(jaccard >= threshold))


def _found_pairs(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, key), (key, rep), (ka, kb, jaccard) of the keys at or above the threshold), all stored."""
    keyed = once_by_column(_class_keys(texts))
    named = once_by_column(keyed.groupBy("key").agg(F.min("doc_id").alias("rep")))
    n = named.count()
    alone, among = _among(texts, named.select(F.col("rep").alias("doc_id")), n)
    often = _held(alone, threshold, np.zeros(0, np.int64), among, OFTEN)
    frequent = often.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)[::-1]
    bits = _filter_bits(4 * n)

    def slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_id_slots(_ids(batch.column(0).to_numpy()), bits))], ["slot"])

    shared = _slots_filter(_held(alone, threshold, frequent, among, 2).mapInArrow(slots, "slot long"), bits)
    met = _meetings(_shared_rows(alone, threshold, frequent, among, shared), threshold)
    pairs = met.groupBy("ka", "kb", "sizes").agg(F.min("places").alias("first")).select("ka", "kb", *_unpacked("sizes", "n"), *_unpacked("first", "p"))
    least = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    pairs = once_by_column(pairs.filter(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least).select("ka", "kb", "na", "nb"))
    blocks = once_by_column(_blocks(pairs).join(named, "key"))
    a, b = (blocks.select(F.col("key").alias(f"k{x}"), F.col("block").alias(f"b{x}")) for x in "ab")
    cell = F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("cell")
    placed = once_by_column(pairs.select("ka", "kb").join(a, "ka").join(b, "kb").select("ka", "kb", cell))
    to = placed.select("cell", F.col("ka").alias("key")).union(placed.select("cell", "kb")).distinct().join(blocks.select("key", F.col("rep").alias("doc_id")), "key")
    to = once_by_column(to)
    sent = to.count()
    rounds, found = max(1, min(ROUNDS, -(-PARTS_OF_SETS * sent // max(1, n)))), []
    for k in range(rounds):
        now, own = to.filter(F.pmod("cell", F.lit(rounds)) == k), placed.toDF("ka", "kb", "at").filter(F.pmod("at", F.lit(rounds)) == k)
        sets = _sets_of(texts, now.select("doc_id"), sent // rounds).join(now, ["key", "doc_id"]).select("cell", "key", "set")
        each = sets.groupBy("cell").cogroup(own.groupBy("at")).applyInArrow(lambda x, y: _compared(x, y, threshold), "ka long, kb long, jaccard double")
        found.append(once_by_column(each))
    return keyed, named, functools.reduce(DataFrame.union, found)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rep) of all documents with a word, (a, b, jaccard) of the representatives at or above the threshold), exactly.

    Documents of equal sets are one class, named after its smallest id.  Two sets that reach the threshold
    share one of the first ``n - ceil(t n) + 1`` shingles of each in any order that is the same for all.  It is that of
    their hashes, with shingles that many prefixes hold last.  Of the prefixes only what several hold is shuffled, packed;
    a pair is told where it meets first, and seldom again.  The place of the first meeting bounds what the sets share.
    The sets of pairs that are left go to blocks of similar ones, once for each other block that they have
    a pair with, not once for each pair.  Shingles are made anew in each pass, of one document a class where it has copies.
    """
    texts = spread(docs.select("doc_id", F.lower("text").alias("text")))
    with settings(docs.sparkSession, LEAN):
        keyed, named, found = _found_pairs(texts, threshold)
    members = keyed.join(named, "key").select("doc_id", "rep")
    found = found.join(named.toDF("ka", "a"), "ka").join(named.toDF("kb", "b"), "kb")
    return members, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of all pairs at or above the threshold, exactly: the classes of :func:`jaccard_classes` spelled out."""
    members, found = jaccard_classes(docs, threshold)
    between = found.union(found.select("b", "a", "jaccard")).union(members.select("rep", F.col("rep").alias("other"), F.lit(1.0)).distinct())
    left, right = members.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
    return left.join(between, "a").join(right, "b").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard")
