"""Vector code compression: every vector as one codebook index for each of its parts.

Vectors become integers, are cut into equal parts, and each part position learns a small
codebook by rounds of nearest entry and integer mean.  The nearest entry is found by a
float32 matrix product whose rounding error is bounded for each product; entries whose
interval of possible distances overlaps that of the best are evaluated again in int64,
and ties go to the lower index.  So codes, codebooks and errors are exact integers,
whatever the order in which a processor adds, and reruns on other clusters agree.

A round is one pass over the vectors: each task sums what it assigned to an entry, the
sums meet by (part, entry) after a partial aggregation, and the driver receives one
codebook (parts x entries x width integers, independent of the number of vectors).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this (after scaling) could overflow squared distances of 64 bits.
MOST = 1 << 27
#: Vectors that are compared at a time.
ROWS = 4096
_UNIT = 2.0**-24  # half a unit in the last place of a float32 in [1, 2)


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest of the integer ``entries`` (k, w) to each integer row of ``x`` (n, w); exact, ties to the lower index.

    Squared distances less the row's own square are ``|c|^2 - 2 x.c``.  A float32
    product of w terms is off by at most g |x| |c| with g = (w+2)u / (1 - (w+2)u), two of
    its roundings being those of the operands, in any order of summation; norms and the
    last subtraction are taken in float64 with room for their own rounding.
    """
    g = (x.shape[1] + 2) * _UNIT
    g = g / (1 - g) * (1 + 1e-6)
    own = (entries.astype(np.float64) ** 2).sum(axis=1)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    off = 2 * g * size[:, None] * (np.sqrt(own) * (1 + 1e-9))[None, :]
    about = own[None, :] - 2 * product
    off += (np.abs(about) + own[None, :]) * 1e-14
    possible = about - off <= (about + off).min(axis=1, keepdims=True)
    best = np.argmax(possible, axis=1)
    row, entry = np.nonzero(possible & (np.count_nonzero(possible, axis=1) > 1)[:, None])
    if len(row):
        exact = np.full(possible.shape, np.iinfo(np.int64).max)
        exact[row, entry] = ((x[row].astype(np.int64) - entries[entry].astype(np.int64)) ** 2).sum(axis=1)
        again = np.unique(row)
        best[again] = np.argmin(exact[again], axis=1)
    return best


def assigned(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(n, parts) indices of the nearest entries of each part's codebook."""
    w = books.shape[2]
    return np.stack([nearest(x[:, p * w : (p + 1) * w], books[p]) for p in range(len(books))], axis=1)


def errors(x: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distance of each row from what its codes stand for."""
    return ((x.astype(np.int64) - decoded(codes, books)) ** 2).sum(axis=1)


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(n, dimension) integer vectors that codes (n, parts) stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def hex_codes(codes: np.ndarray) -> list[str]:
    """Two hex digits an index, in part order."""
    return [bytes(r).hex() for r in codes.astype(np.uint8)]


def digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """(vec_id, label, components as little-endian int32) of the vectors without null and non-finite components; stored."""
    v = F.col(f"`{vector}`")
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"), v.alias("v")).filter(
        "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )

    def made(batches):
        for whole in batches:
            for batch in pieces(whole, ROWS):
                column = batch.column(2)
                sizes = np.diff(column.offsets.to_numpy())
                flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if len(flat) and np.abs(flat).max() > MOST:
                    raise ValueError(f"a vector component is beyond {MOST // scale} in magnitude")
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(flat.astype("<i4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["vec_id", "label", "data"])

    kinds = dict(kept.dtypes)
    return stored(kept.mapInArrow(made, f"vec_id {kinds['vec_id']}, label {kinds['label']}, data binary"), "vectors")


def _rows(column, dimension: int) -> np.ndarray:
    """The vectors of a binary column as (n, dimension) int32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
    if len(flat) != len(column) * dimension:
        raise ValueError(f"vectors differ in length: {dimension} components are expected")
    return flat.reshape(len(column), dimension)


def fit_codebooks(data: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of stored vectors; None if there are none.

    They start as the parts of the vectors of smallest id (null ids last; repeated ids by
    their components).  Every vector counts in every round.
    """
    first = data.orderBy(F.col("vec_id").asc_nulls_last(), "data").limit(entries).select("data").collect()
    if not first:
        return None
    start = [np.frombuffer(r.data, "<i4").astype(np.int64) for r in first]
    dimension = len(start[0])
    if not dimension or dimension % parts or any(len(s) != dimension for s in start):
        raise ValueError(f"vectors must have equal lengths that {parts} parts divide")
    width = dimension // parts
    books = np.stack([np.stack([s[p * width : (p + 1) * width] for s in start]) for p in range(parts)])
    for _ in range(rounds):
        books = _moved(data, books)
    return books


def _moved(data: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry replaced by the componentwise floor of its parts' mean."""
    parts, entries, width = books.shape

    def summed(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for whole in batches:
            for batch in pieces(whole, ROWS):
                x = _rows(batch.column(0), parts * width)
                codes = assigned(x, books)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width].astype(np.int64)
                    order = np.argsort(codes[:, p], kind="stable")
                    used, begin = np.unique(codes[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(own[order], begin, axis=0)
                    counts[p, used] += np.diff(begin, append=len(order))
        p, e = np.nonzero(counts)
        arrays = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "total"])

    partial = data.select("data").mapInArrow(summed, "part int, entry int, n long, total array<long>")
    added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    moved = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts x entries rows
        moved[r.part, r.entry] = [int(r[f"t{i}"]) // r.n for i in range(width)]
    return moved


def encode_vectors(data: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of stored vectors."""
    parts, _, width = books.shape
    kinds = dict(data.dtypes)

    def made(batches):
        for whole in batches:
            for batch in pieces(whole, ROWS):
                x = _rows(batch.column(2), parts * width)
                codes = assigned(x, books)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hex_codes(codes), pa.string()), pa.array(errors(x, books, codes))], names=["vec_id", "label", "code", "error"])

    return data.select("vec_id", "label", "data").mapInArrow(made, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error, label_error) of the vectors kept, their codebooks).

    Component x counts as floor(scale * x).  Vectors that are null or hold null or
    non-finite components are dropped; zero vectors count like others.  Rows that repeat
    an id or a whole row are coded each; null ids come last where codebooks start and are
    coded too.  With fewer vectors than entries the codebooks have as many entries as
    there are vectors.  Ties go to the lower index, means are rounded down, an entry that
    nothing chose stays.  ``label_error`` is the sum of errors over equal labels, nulls
    together.  No vectors give no rows and no codebooks.  All lengths must be equal and a
    multiple of ``parts``, magnitudes at most MOST / scale; otherwise it raises ValueError.
    Only the three named columns are read, so other names do not matter; at most 256
    entries fit a code.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    data = whole_vectors(vectors, vec_id, vector, label, scale)
    books = fit_codebooks(data, parts, entries, rounds)
    if books is None:
        empty = data.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.limit(0), None
    coded = stored(encode_vectors(data, books), "codes")
    # one row a label; rows without a label, a hot label perhaps, do not meet in one task, for the join may split them
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "its")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("its")), "left").select("vec_id", "label", "code", "error", "label_error"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings with their errors and the digest of the codebooks."""
    coded, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))


def _op11_sql() -> str:
    """The rounds as chained expressions over one row a part; distances by lists of integers."""
    nearest_sql = """SELECT x.vec_id, x.label, x.part, x.w, arg_min(b.entry, (list_sum(list_transform(list_zip(x.w, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry,
        min(list_sum(list_transform(list_zip(x.w, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
      FROM pieces x JOIN {books} b ON x.part = b.part GROUP BY ALL"""
    rounds = ", ".join(
        f"""a{i} AS MATERIALIZED ({nearest_sql.format(books=f'b{i}')}),
    b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (
      SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM (
        SELECT part, entry, k, sum(v) AS s, count(*) AS n FROM (SELECT part, entry, unnest(w) AS v, generate_subscripts(w, 1) AS k FROM a{i}) GROUP BY ALL)
      GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""
        for i in range(ROUNDS)
    )
    return f"""WITH kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), pieces AS MATERIALIZED (
      SELECT vec_id, label, p AS part, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS w FROM kept, range({PARTS}) t(p)
    ), b0 AS MATERIALIZED (
      SELECT part, rank - 1 AS entry, w AS c FROM (SELECT part, w, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM pieces) WHERE rank <= {ENTRIES}
    ), {rounds}, last AS MATERIALIZED ({nearest_sql.format(books=f'b{ROUNDS}')}),
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM last GROUP BY vec_id, label),
    total AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label),
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
    SELECT c.vec_id, c.code, c.error, t.label_error, book.codebooks_sha256
    FROM coded c JOIN total t ON c.label IS NOT DISTINCT FROM t.label, book"""


OP11_SQL = _op11_sql()
