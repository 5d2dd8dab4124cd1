"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Word vectors come from the whole corpus.  Every word has a sparse ternary index
vector fixed by its hash; the vector of a word is the sum of the index vectors of
its neighbours, over all documents.  A second, small table does the same for word
shapes (case, digits, punctuation, repetition of the word before).  The tables have
a fixed size, and integer partial sums of the tasks add up to the same table however
the rows are partitioned.  A document is the mean of its words' vectors; a
two-layer numpy network scores it, and one temperature, fitted on rows that the
network was not trained on, makes its outputs probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, _random, as_binary, by_group, fold, mix64, pieces
from .labelled import labelled_sample

#: Slots of the word table, and of the shape table (its last slot: the word before, again).
WORDS, SHAPES = 1 << 14, 513
DIMENSIONS, NONZERO, WINDOW = 32, 3, 2
CHUNKS = 64
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 8_000
HIDDEN = 32
THRESHOLD = 0.3
#: Whether a byte is a letter or digit, its class in the shape, and random numbers of both, zero for white space.
_CORE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_CLASS = np.array([c if not _CORE[c] else ord("0") if 48 <= c < 58 else ord("A") if 65 <= c < 91 else ord("a") for c in range(256)], np.uint8)
_CLASS[9:14] = 0x20
_CORE_BYTES = np.where(_CORE, _random(256, 11)[np.array([c + 32 if 65 <= c < 91 else c for c in range(256)])], np.uint64(0))
_SHAPE_BYTES = _random(256, 12)
_SHAPE_BYTES[0x20] = 0
SHAPE_BYTES = 12


def index_vectors(slots: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero components of each slot's index vector."""
    ids = np.arange(slots, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)
    bits = mix64(ids + np.uint64(salt) * np.uint64(1 << 40))
    return (bits % np.uint64(DIMENSIONS)).astype(np.int64), np.where((bits >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int8)


def units_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core slots, shape slots, number of words of each text) of a list of texts.

    A word's core are its letters and digits, in lower case; its shape are the classes of
    its bytes, of a run of one class two at most, the first ``SHAPE_BYTES`` of them.
    """
    w = Words(texts)
    lengths = w.lengths
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lengths
    lead, most = int(w.starts[0]), int(w.sizes.max())
    rank = np.minimum(w.ranks(_CORE[w.bytes].astype(np.int32)), most)
    core = (mix64(w.sums(_CORE_BYTES[w.bytes[lead:]] * (_random(most + 1, 13) | np.uint64(1))[rank])) % np.uint64(WORDS)).astype(np.int64)
    kind = _CLASS[w.bytes]
    kept = kind != 0x20
    kept[2:] &= (kind[2:] != kind[1:-1]) | (kind[1:-1] != kind[:-2])
    rank = np.minimum(w.ranks(kept.astype(np.int32)), SHAPE_BYTES)
    factors = _random(SHAPE_BYTES + 1, 14) | np.uint64(1)
    factors[-1] = 0
    kind[~kept] = 0x20
    shape = (mix64(w.sums(_SHAPE_BYTES[kind[lead:]] * factors[rank])) % np.uint64(SHAPES - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    again = np.zeros(len(core), bool)
    again[1:] = (core[1:] == core[:-1]) & (owner[1:] == owner[:-1])
    shape[again] = SHAPES - 1
    return core, shape, lengths


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape vectors from every document.

    Each task adds into two fixed-size tables and hands them on in ``CHUNKS`` pieces;
    the pieces are summed by key, and the sums (2 MB whatever the corpus) come to the
    driver.
    """

    def partial(batches):
        pos_w, sign_w = index_vectors(WORDS, 1)
        pos_s, sign_s = index_vectors(SHAPES, 2)
        table = np.zeros((WORDS + SHAPES) * DIMENSIONS)  # whole numbers, exact up to 2**53
        for whole in batches:
            for part in pieces(whole, 1024, 1_000_000):
                core, shape, lengths = units_of(as_binary(part.column(0)).to_pylist())
                owner = np.repeat(np.arange(len(lengths)), lengths)
                for off in range(1, WINDOW + 1):
                    at = np.flatnonzero(owner[off:] == owner[:-off])
                    if not len(at):
                        continue
                    for a, b in ((at, at + off), (at + off, at)):
                        for k in range(NONZERO):
                            sums = np.bincount(core[a] * DIMENSIONS + pos_w[core[b], k], weights=sign_w[core[b], k], minlength=WORDS * DIMENSIONS)
                            table[: WORDS * DIMENSIONS] += sums
                            if off == 1:
                                sums = np.bincount(shape[a] * DIMENSIONS + pos_s[shape[b], k], weights=sign_s[shape[b], k], minlength=SHAPES * DIMENSIONS)
                                table[WORDS * DIMENSIONS :] += sums
        if table.any():
            cut = np.array_split(table.astype(np.int64), CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["chunk", "sums"])

    def summed(key, batches):
        total = None
        for batch in batches:
            for x in batch.column(1).to_pylist():
                x = np.frombuffer(x, np.int64)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])

    got = docs.select("text").mapInArrow(partial, "chunk int, sums binary").groupBy("chunk").applyInArrow(by_group(summed), "chunk int, sums binary").collect()
    table = np.concatenate([np.frombuffer(r.sums, np.int64) for r in sorted(got, key=lambda r: r.chunk)]) if got else np.zeros((WORDS + SHAPES) * DIMENSIONS)
    out = []
    for sums, slots, salt in ((table[: WORDS * DIMENSIONS], WORDS, 1), (table[WORDS * DIMENSIONS :], SHAPES, 2)):
        v = sums.reshape(slots, DIMENSIONS).astype(np.float64)
        v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
        pos, sign = index_vectors(slots, salt)
        for k in range(NONZERO):
            np.add.at(v, (np.arange(slots), pos[:, k]), 0.5 * sign[:, k])
        out.append(v.astype(np.float32))
    return out[0], out[1]


def _sums(v: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each run of ids; long runs are cut, so that the rows held at a time are few."""
    out = np.zeros((len(starts), v.shape[1]))
    ends = np.append(starts[1:], len(ids))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 32_768)))
        if hi == lo + 1:  # as counts by slot, however long
            times = np.bincount(ids[starts[lo] : ends[lo]], minlength=len(v))
            used = np.flatnonzero(times)
            out[lo] = times[used] @ v[used].astype(np.float64)
        else:
            out[lo:hi] = np.add.reduceat(v[ids[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], axis=0)
        lo = hi
    return out


def pooled(texts: list[bytes | None], vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row per text: means of its word and shape vectors, its length, and whether it is empty."""
    core, shape, lengths = units_of(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2), np.float64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        for k, (ids, v) in enumerate(((core, vectors[0]), (shape, vectors[1]))):
            out[full, k * DIMENSIONS : (k + 1) * DIMENSIONS] = _sums(v, ids, starts) / lengths[full, None]
    out[:, -2], out[:, -1] = np.log1p(lengths) / 8, lengths == 0
    return out


class Network:
    """tanh layer and logistic output; ``temperature`` divides the logit."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> "Network":
        """Adam on four fifths of the rows; the temperature on the last fifth."""
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        if len(y) < 10 or y.min() == y.max():
            base = (y.sum() + 0.5) / (len(y) + 1)
            return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(base / (1 - base))))
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        rest, ours = order[:cut], order[cut:]
        mean, scale = x[ours].mean(0), x[ours].std(0) + 1e-3
        net = Network(mean, scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(()))
        moments = {k: [0.0, 0.0] for k in ("w1", "b1", "w2", "b2")}
        step = 0
        for _ in range(epochs):
            rng.shuffle(ours)
            for at in range(0, len(ours), batch):
                ids = ours[at : at + batch]
                z = (x[ids] - mean) / scale
                h = np.tanh(z @ net.w1 + net.b1)
                error = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[ids]) / len(ids)
                back = np.outer(error, net.w2) * (1 - h * h)
                grads = {"w1": z.T @ back + decay * net.w1, "b1": back.sum(0), "w2": h.T @ error + decay * net.w2, "b2": error.sum()}
                step += 1
                for k, g in grads.items():
                    m = moments[k]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    setattr(net, k, getattr(net, k) - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        z = net.logit(x[rest])
        grid = np.exp(np.linspace(np.log(0.5), np.log(4), 60))
        loss = [np.mean(np.logaddexp(0, -np.where(y[rest] > 0, z, -z) / t)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
        return net


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, bound: int = SAMPLE, label: str = "quality"):
    """(vectors, network): vectors from all documents, the network from at most ``bound`` labelled rows."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for whole in batches:
            for part in pieces(whole, 1024, 1_000_000):
                x = pooled(as_binary(part.column("text")).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"]
                )

    got = labelled_sample(docs, labels, label, modulus, held, bound).mapInArrow(features, "doc_id long, label int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), 2 * DIMENSIONS + 2)
    return vectors, Network.fit(x, np.array([r.label for r in got], float))


def score_quality(docs: DataFrame, vectors, network: Network, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_predicted``; one pass, no shuffle.

    Null and empty texts are scored as a text without words; repeated rows are scored
    each; an input column named ``quality_score`` or ``quality_predicted`` is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vectors, network))
    docs = docs.drop("quality_score", "quality_predicted")
    docs = docs.select(*keep) if keep else docs
    carried = [c for c in docs.columns if keep is None or c != "text"]
    schema = docs.select(*carried).schema.add("quality_score", "double")

    def scored(batches):
        vectors, network = shared.value
        for whole in batches:
            for part in pieces(whole, 1024, 1_000_000):
                x = pooled(as_binary(part.column(part.schema.get_field_index("text"))).to_pylist(), vectors)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in carried] + [pa.array(network.score(x), pa.float64())], [*carried, "quality_score"]
                )

    return docs.mapInArrow(scored, schema).withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every whole document; fold ``crc32 mod 5 = 0`` is held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors, network = fit_quality(docs, labels)
    out = score_quality(docs, vectors, network, keep=["doc_id", "text"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
