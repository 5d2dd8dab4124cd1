"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words with their beginnings of three to six letters and
endings of three to five, hashed into ``BUCKETS`` slots.  Besides a weight for each slot the model holds a short vector
for each, and the product of two vectors scores the pair, so that an insult near a
group mention can weigh more than the sum of both.  Fitting uses a bounded sample
(``SAMPLE`` labelled rows); scoring takes every whole text in one pass without a
shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_WORDS, as_binary, by_group, fold, give_back, pieces, stored
from .labelled import labelled_sample

BUCKETS = 1 << 18
RANK = 4
#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 10_000
THRESHOLD = 0.7
#: Parts in which counts by slot travel.
CHUNKS = 16
_TRIM = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")


class Terms(dict):
    """word -> tuple of its slots (the word, its beginnings and endings), remembered; bounded.

    With ``kept`` (slot -> position of its parameters, 0 for none) only slots that
    have parameters are listed.
    """

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        core = _TRIM.sub(b"", word)
        letters = core.decode("utf-8", "replace").lower()
        found = []
        if letters:
            found.append("w" + letters)
            found += ["p" + letters[:n] for n in (3, 4, 5, 6) if len(letters) > n]
            found += ["s" + letters[-n:] for n in (3, 4, 5) if len(letters) > n]
        slots = tuple(xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS for x in found)
        if self.kept is not None:
            slots = tuple(s for s in slots if self.kept[s])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = slots
        return slots


def slots_of(text: bytes | None, terms: Terms) -> np.ndarray:
    """Sorted distinct slots of a text; none for null or empty texts."""
    words = set((text or b"").lower().split())
    found = set()
    for w in words:
        found.update(terms[w])
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def slot_counts(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, positive rows) of each slot; the slots of a row are distinct."""
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for slots, y in zip(rows, labels, strict=True):
        seen[slots] += 1
        if y:
            toxic[slots] += 1
    return seen, toxic


class FactorizationMachine:
    """Binary features, logistic loss, AdaGrad; the slots that tell the classes apart keep parameters."""

    def __init__(self, bias: float, weight: np.ndarray, vector: np.ndarray, slot_of: np.ndarray):
        self.bias, self.weight, self.vector, self.slot_of = bias, weight, vector, slot_of

    @staticmethod
    def telling(seen: np.ndarray, toxic: np.ndarray, n: int, positive: float) -> np.ndarray:
        """Slots that tell the classes apart: by chi-square against the label; rare or indifferent ones get no parameters.

        Keeping slots by their counts instead brought 60,000 to 80,000 of them and half the
        held-out recall on 2,600 examples.
        """
        expected = seen * positive / n
        chi = (toxic - expected) ** 2 / np.maximum(1e-9, expected * (1 - seen / n) * (1 - positive / n))
        return np.flatnonzero((seen >= 2) & (chi >= 12.0) & (toxic > expected * 1.3) | (seen >= 20) & (chi >= 12.0))

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray, keep: np.ndarray | None = None, epochs: int = 12, batch: int = 64, rate: float = 0.15, decay: float = 2e-4, seed: int = 7) -> "FactorizationMachine":
        n, positive = len(rows), float(labels.sum())
        if n == 0 or positive in (0.0, float(n)):
            base = (positive + 0.5) / (n + 1)
            return FactorizationMachine(float(np.log(base / (1 - base))), np.zeros(1), np.zeros((1, RANK)), np.zeros(BUCKETS, np.int32))
        if keep is None:
            keep = FactorizationMachine.telling(*slot_counts(rows, labels), n, positive)
        slot_of = np.zeros(BUCKETS, np.int32)
        slot_of[keep] = np.arange(1, len(keep) + 1)
        rng = np.random.default_rng(seed)
        weight, vector = np.zeros(len(keep) + 1), rng.normal(0, 0.03, (len(keep) + 1, RANK))
        vector[0] = 0
        bias = float(np.log(positive / (n - positive)))
        gw, gv, gb = np.full(len(weight), 1e-2), np.full(vector.shape, 1e-2), 1e-2
        kept = [slot_of[r] for r in rows]
        kept = [k[k > 0] for k in kept]
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                ids = order[at : at + batch]
                lengths = np.array([len(kept[i]) for i in ids])
                idx = np.concatenate([kept[i] for i in ids])
                owner = np.repeat(np.arange(len(ids)), lengths)
                summed = np.zeros((len(ids), RANK))
                np.add.at(summed, owner, vector[idx])
                squares = np.bincount(owner, weights=(vector[idx] ** 2).sum(1), minlength=len(ids))
                z = bias + np.bincount(owner, weights=weight[idx], minlength=len(ids)) + 0.5 * ((summed**2).sum(1) - squares)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[ids]
                g = error.sum()
                gb += g * g
                bias -= rate * g / np.sqrt(gb)
                if not len(idx):
                    continue
                touched, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, weights=error[owner], minlength=len(touched)) + decay * len(ids) * weight[touched]
                dv = np.zeros((len(touched), RANK))
                np.add.at(dv, back, error[owner, None] * (summed[owner] - vector[idx]))
                dv += 5 * decay * len(ids) * vector[touched]
                gw[touched] += dw**2
                gv[touched] += dv**2
                weight[touched] -= rate * dw / np.sqrt(gw[touched])
                vector[touched] -= rate * dv / np.sqrt(gv[touched])
        return FactorizationMachine(bias, weight, vector, slot_of)

    def score(self, slots: np.ndarray) -> float:
        idx = self.slot_of[slots]
        idx = idx[idx > 0]
        v = self.vector[idx]
        z = self.bias + self.weight[idx].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, bound: int = SAMPLE, label: str = "toxic") -> FactorizationMachine:
    """Fit on at most ``bound`` labelled rows outside the held-out fold.

    Slots are counted by the executors, who then send the numbers of telling slots only;
    rows come in id order, so that reruns agree.  Without examples of both classes the machine answers the base rate.
    """

    def features(batches):
        terms = Terms()
        for whole in batches:
            for part in pieces(whole):
                texts = as_binary(part.column("text")).to_pylist()
                out = [slots_of(t, terms).astype("<i4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array(out, pa.binary())], ["doc_id", "label", "slots"]
                )

    spark = docs.sparkSession
    rows = stored(labelled_sample(docs, labels, label, modulus, held, bound).mapInArrow(features, "doc_id long, label int, slots binary"), "slots")

    def counted(batches):
        total = np.zeros((2, BUCKETS))
        size = np.zeros(2)
        for batch in batches:
            y = np.asarray(batch.column(1).to_pylist(), float)
            total += slot_counts([np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()], y)
            size += (len(y), y.sum())
        if size[0]:
            parts = np.array_split(np.append(total.ravel(), size), CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "sums"])

    def added(key, batches):
        total = sum(np.frombuffer(x, np.float64) for b in batches for x in b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])

    sums = rows.mapInArrow(counted, "chunk int, sums binary").groupBy("chunk").applyInArrow(by_group(added), "chunk int, sums binary").collect()
    if not sums:
        return FactorizationMachine.fit([], np.zeros(0))
    *counts, n, positive = np.concatenate([np.frombuffer(r.sums) for r in sorted(sums, key=lambda r: r.chunk)])
    seen, toxic = np.reshape(counts, (2, BUCKETS))
    keep = FactorizationMachine.telling(seen, toxic, int(n), positive)
    shared = spark.sparkContext.broadcast(np.isin(np.arange(BUCKETS), keep))

    def telling(batches):
        for batch in batches:
            found = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[shared.value[x]].tobytes() for x in found], pa.binary())], ["doc_id", "label", "slots"])

    got = rows.mapInArrow(telling, "doc_id long, label int, slots binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.slots)))
    return FactorizationMachine.fit([np.frombuffer(r.slots, "<i4") for r in got], np.array([r.label for r in got], float), keep)


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_predicted``.

    Null and empty texts get the base score; repeated rows are scored each.  The
    model is a fixed-size object (``BUCKETS`` slot numbers and the kept parameters),
    which is what gets sent to the executors.  An input column named ``toxicity`` or
    ``toxic_predicted`` is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)
    docs = docs.drop("toxicity", "toxic_predicted")
    docs = docs.select(*keep) if keep else docs
    carried = [c for c in docs.columns if keep is None or c != "text"]
    schema = docs.select(*carried).schema.add("toxicity", "double")

    def scored(batches):
        model = shared.value
        terms = Terms(model.slot_of)
        for whole in batches:
            for part in pieces(whole):
                texts = as_binary(part.column(part.schema.get_field_index("text"))).to_pylist()
                scores = [model.score(slots_of(t, terms)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in carried] + [pa.array(scores, pa.float64())], [*carried, "toxicity"])
        del terms
        give_back()

    return docs.mapInArrow(scored, schema).withColumn("toxic_predicted", (F.col("toxicity") >= threshold).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document; fold ``crc32 mod 3 = 1`` is held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit_toxicity(docs, labels)
    out = score_toxicity(docs, machine, keep=["doc_id", "text"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"))
