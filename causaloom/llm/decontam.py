"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

An item leaks into a document if some stretch of the document turns into the item
by at most ``rate`` edits a word (insert, delete or replace a word; words are
lower-cased and stripped of outer punctuation).  Candidate search:

1. Items of like length share a window size, more than half of their length.  Documents are
   cut into windows of each size in use, one every quarter of a window; the items into
   windows at every place, so that an intact item always holds a window that is equal
   to one of its own.
2. The CGK random walk copies the word that it stands on and moves on or stays, as a
   hash of word and step tells; of two windows that few edits part, the copies differ in
   few places.  ``WALKS`` walks with ``SAMPLES`` samples of ``SYMBOLS`` places each
   make the keys of the hash tables; a window that shares a key with a window of an item
   is a candidate.  Recall is measured in the tests: all intact items and at least 95 %
   of those with edits up to the rate.
3. Candidates around which too many of the item's words are missing are no leaks; the
   others are checked by the exact edit distance of the item to the best stretch around
   the window.

Items travel in pieces of at most ``ITEMS`` items and ``ITEM_BYTES`` bytes; a larger
benchmark takes several passes over the documents, each within that bound.
Documents are read in place: no shuffle, whatever is common to many of them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import CACHE_WORDS, as_binary, give_back, pieces

RATE = 0.2
#: Items of fewer words are too short to tell a leak from a common phrase; they match nothing.
LEAST_WORDS = 5
WALKS, SAMPLES, SYMBOLS = 3, 8, 4
ITEMS, ITEM_BYTES = 4_000, 8_000_000
#: Windows that are embedded together, and pairs of a window and an item that are looked at together.
WINDOWS, PAIRS = 8_192, 1_000_000
_EDGE = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
_ODD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class CoreHash(dict):
    """word -> hash of the word without case and outer punctuation (0: nothing left); bounded."""

    def __missing__(self, word: bytes) -> int:
        core = word.lower()
        if not core.isalnum():
            core = _EDGE.sub(b"", core)
        value = xxhash.xxh3_64_intdigest(core) | 1 if core else 0
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def cores_of(text: bytes | None, cache: CoreHash) -> np.ndarray:
    words = text.split() if text else ()
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


def window_size(n: int) -> tuple[int, int]:
    """(words, distance of two starts) of the windows for items of ``n`` words; every stretch of n words holds one."""
    size, stride, larger = 1, 1, 2
    while larger + max(1, larger // 4) - 1 <= n:
        size, stride = larger, max(1, larger // 4)
        larger = max(larger + 1, larger * 3 // 2)
    return size, stride


@lru_cache(maxsize=256)
def _plan(size: int) -> list[tuple[np.ndarray, dict[int, list[int]]]]:
    """For each walk its step hashes and, by place, the samples that take it."""
    plan = []
    for walk in range(WALKS):
        rng = np.random.default_rng([size, walk])
        steps = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        taken: dict[int, list[int]] = {}
        for sample in range(SAMPLES):
            for place in rng.choice(2 * size, size=min(SYMBOLS, 2 * size), replace=False).tolist():
                taken.setdefault(place, []).append(walk * SAMPLES + sample)
        plan.append((steps, taken))
    return plan


def lsh_keys(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(WALKS * SAMPLES, windows) keys of the windows of ``size`` words at ``starts``.

    A walk takes two steps a word and stays on the last word of its window.
    """
    keys = np.empty((WALKS * SAMPLES, len(starts)), np.uint64)
    keys[:] = (np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9))[:, None]
    last = starts + (size - 1)
    for steps, taken in _plan(size):
        at = starts.astype(np.int64)
        for j in range(max(taken) + 1):
            symbol = h.take(at)
            for k in taken.get(j, ()):
                key = keys[k]
                key ^= symbol
                key *= _ODD
                key ^= key >> _TURN
            symbol *= steps[j]
            symbol >>= np.uint64(63)
            at += symbol.view(np.int64)
            if j >= size - 1:
                np.minimum(at, last, out=at)
    return keys


class Table:
    """Keys of the windows of all items of one window size, sorted, with a bitmap in front."""

    def __init__(self, size: int, stride: int, items: list[tuple[int, np.ndarray]]):
        self.size, self.stride = size, stride
        keys, entries = [], []
        for at, words in items:
            places = np.arange(len(words) - size + 1)
            k = lsh_keys(words, places, size)
            keys.append(k.ravel())
            entries.append(np.tile(np.stack([np.full(len(places), at), places]), (1, len(k))))
        keys, entries = np.concatenate(keys), np.concatenate(entries, axis=1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.places = keys[order], entries[0, order].astype(np.int32), entries[1, order].astype(np.int32)
        bits = min(26, max(20, (32 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray, starts: np.ndarray):
        """Arrays (window, item, place in the item) of windows that share a key, in parts of bounded size."""
        k = lsh_keys(h, starts, self.size)
        window = np.flatnonzero(self.bitmap.take((k >> self.shift).view(np.int64)).ravel())
        k = k.ravel()[window]
        window %= len(starts)
        lo, hi = np.searchsorted(self.keys, k), np.searchsorted(self.keys, k, side="right")
        some = hi > lo
        window, lo, n = window[some], lo[some], (hi - lo)[some]
        ends = np.cumsum(n)
        first = 0
        while first < len(n):
            upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
            m = n[first:upto]
            entry = np.repeat(lo[first:upto] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            yield np.repeat(window[first:upto], m), self.items[entry], self.places[entry]
            first = upto


def best_stretch(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int]:
    """(least edits that turn a stretch of ``text`` into ``item``, end of that stretch)."""
    n = len(text)
    places = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (text != word), out=new[1:])
        row = np.minimum.accumulate(new - places) + places
        if row.min() > limit:
            return limit + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


class ItemIndex:
    """Items and the hash tables of their windows."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        cache = CoreHash()
        self.items, self.vocabulary = [], []
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or b"")):
            h = cores_of(text, cache)
            if len(h) < LEAST_WORDS:
                continue
            by_size.setdefault(window_size(len(h)), []).append((len(self.items), h))
            self.items.append((item_id, h, int(rate * len(h))))
            self.vocabulary.append(frozenset(h.tolist()))
        self.tables = [Table(size, stride, group) for (size, stride), group in sorted(by_size.items())]

    def candidates(self, texts: list[np.ndarray]):
        """(text, item, place at which the item would start) of all windows that share a key with an item's."""
        sizes = np.array([len(h) for h in texts], np.int64)
        gap = max((t.size for t in self.tables), default=0)
        base = np.cumsum(sizes + gap) - (sizes + gap)
        joined = np.zeros(int((sizes + gap).sum()), np.uint64)
        for h, at in zip(texts, base.tolist(), strict=True):
            joined[at : at + len(h)] = h
        for table in self.tables:
            n = np.where(sizes > 0, np.maximum(0, sizes - table.size) // table.stride + 1, 0)
            of = np.repeat(np.arange(len(texts)), n)
            within = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * table.stride
            for lo in range(0, len(of), WINDOWS):
                text, place = of[lo : lo + WINDOWS], within[lo : lo + WINDOWS]
                for window, item, off in table.hits(joined, base[text] + place):
                    yield from np.unique(np.stack([text[window], item, place[window] - off]), axis=1).T.tolist()

    def matches(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, start and end in words, edits) of the best stretch for each item found."""
        best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        words: dict[int, list[int]] = {}
        for i, at, start in self.candidates(texts):
            _, item, k = self.items[at]
            if i not in words:
                words = {i: texts[i].tolist()}
            known = self.vocabulary[at]
            if len(known.intersection(words[i][max(0, start - 2 * k) : start + len(item) + 2 * k])) >= len(known) - k:
                self._verify(texts[i], max(0, start), at, best[i])
        return [[found[k] for k in sorted(found)] for found in best]

    def _verify(self, h: np.ndarray, start: int, at: int, best: dict) -> None:
        item_id, words, k = self.items[at]
        if (old := best.get(item_id)) and old[3] == 0:
            return
        if np.array_equal(h[start : start + len(words)], words):
            best[item_id] = (item_id, start, start + len(words), 0)
            return
        lo = max(0, start - 2 * k)
        edits, end = best_stretch(words, h[lo : start + len(words) + 2 * k], k)
        if edits <= k and (old is None or edits < old[3]):
            best[item_id] = (item_id, start, lo + end, edits)


def item_pieces(benchmark: DataFrame, items: int = ITEMS, most_bytes: int = ITEM_BYTES):
    """Lists of (item_id, text) within the bounds; null ids and texts are left out."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = b.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    k = max(1, -(-total.n * 2 // items), -(-(total.b or 0) * 2 // most_bytes))
    for i in range(k if total.n else 0):
        part = b if k == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        yield [(r.item_id, r.text.encode()) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, items: int = ITEMS) -> DataFrame:
    """``docs`` with ``leaks``: array of (item_id, start, end, edits), empty for clean documents.

    Items of fewer than ``LEAST_WORDS`` words match nothing.  Positions count words that hold a letter or digit.  Null, empty and wordless texts are clean;
    repeated rows are looked at each and very long ones whole; of equally good
    stretches one is named; an input column named ``leaks`` is replaced.  An
    empty benchmark leaks nowhere.
    """
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    names = docs.columns
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "edits"))]))
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", kind)])
    arrow_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    out = None
    for group in item_pieces(benchmark, items):
        shared = spark.sparkContext.broadcast(ItemIndex(group, rate))

        def scan(batches, shared=shared):
            cache, index = CoreHash(), shared.value
            for whole in batches:
                for part in pieces(whole):
                    texts = as_binary(part.column(names.index("text"))).to_pylist()
                    matched = index.matches([cores_of(t, cache) for t in texts])
                    found = [[dict(zip(("item_id", "start", "end", "edits"), m, strict=True)) for m in of] for of in matched]
                    rows = part.columns[: len(names)]
                    if part.num_columns > len(names):
                        found = [a + b for a, b in zip(part.column(len(names)).to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(found, arrow_kind)], [*names, "leaks"])
            del cache
            give_back()

        base = docs if out is None else out
        out = base.mapInArrow(scan, schema)
    return docs.withColumn("leaks", F.from_json(F.lit("[]"), kind)) if out is None else out


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that leak into it."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_leaks(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"),
    )
