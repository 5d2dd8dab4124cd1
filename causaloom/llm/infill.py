"""Fill-in-middle transformation on ropes.

A text becomes a balanced tree over short leaves; every node caches how many units and
code points it holds.  Two splits at unit ranks give prefix, middle and suffix; the
output is a concatenation of these subtrees and of sentinel leaves, no text is copied
until it is written out.  The inverse makes a rope of the output, finds the sentinels,
splits there and concatenates the parts in their old order.  Every document is
transformed by itself, so the job has no shuffle and its memory follows one document.

A unit is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched from left to
right: a word with the white space in front of it, or white space that ends the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _SPACE, as_binary, fresh, pieces

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of a leaf, and of the leaves that are counted at a time.
LEAF, BLOCK = 2048, 1 << 20
_LEADS = (np.arange(256) & 0xC0) != 0x80


class Rope:
    """A leaf (``data``) or the concatenation of two ropes; ``units``, ``chars`` and ``size`` (bytes) are cached."""

    __slots__ = ("left", "right", "data", "units", "chars", "size")

    def __init__(self, data=None, units: int = 0, chars: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.data, self.left, self.right = data, left, right
        if left is None:
            self.units, self.chars, self.size = units, chars, len(data)
        else:
            self.units, self.chars, self.size = left.units + right.units, left.chars + right.chars, left.size + right.size

    def leaves(self):
        """The bytes of the leaves from left to right."""
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.left is None:
                yield node.data
            else:
                open_ += (node.right, node.left)

    def __bytes__(self) -> bytes:
        return b"".join(self.leaves())


EMPTY = Rope(b"")


def _unit_ends(data, closed: bool) -> np.ndarray:
    """Which bytes end a unit: those of words before white space, and the last one if ``closed``."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[-1] = closed
    return ends


def rope_of(text: bytes, leaf: int = LEAF) -> Rope:
    """A balanced rope of a UTF-8 text; leaves begin at code points."""
    if not text:
        return EMPTY
    view, b = memoryview(text), np.frombuffer(text, np.uint8)
    cuts = np.arange(0, len(b), leaf)
    for _ in range(3):  # a code point has three more bytes at most
        inside = ~_LEADS[b[np.minimum(cuts, len(b) - 1)]] & (cuts < len(b))
        inside[0] = False
        cuts = cuts + inside
    cuts = np.unique(cuts[cuts < len(b)])
    nodes, per = [], max(1, BLOCK // leaf)
    for k in range(0, len(cuts), per):
        own = cuts[k : k + per]
        stop = int(cuts[k + per]) if k + per < len(cuts) else len(b)
        begin = int(own[0])
        closed = stop == len(b) or bool(_SPACE[b[stop]] and not _SPACE[b[stop - 1]])
        units = np.add.reduceat(_unit_ends(view[begin:stop], closed).view(np.int8), own - begin, dtype=np.int64).tolist()
        chars = np.add.reduceat(_LEADS[b[begin:stop]].view(np.int8), own - begin, dtype=np.int64).tolist()
        edges = [*own.tolist(), stop]
        nodes += [Rope(view[s:e], u, c) for s, e, u, c in zip(edges, edges[1:], units, chars, strict=False)]
    while len(nodes) > 1:
        nodes = [joined(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


def joined(*ropes: Rope) -> Rope:
    """The concatenation of the ropes."""
    out = EMPTY
    for x in ropes:
        out = Rope(left=out, right=x) if out.size and x.size else x if x.size else out
    return out


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What ends with the unit (or code point) of that rank, counted from 1, and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank > getattr(rope, by):
        return rope, EMPTY
    if rope.left is not None:
        before = getattr(rope.left, by)
        if rank <= before:
            a, b = split(rope.left, rank, by)
            return a, joined(b, rope.right)
        a, b = split(rope.right, rank - before, by)
        return joined(rope.left, a), b
    if by == "units":
        ends = _unit_ends(rope.data, False)
        ends[-1] = np.count_nonzero(ends) < rope.units  # the unit that ends with the leaf
        at = int(np.flatnonzero(ends)[rank - 1]) + 1
        units, chars = rank, int(np.count_nonzero(_LEADS[np.frombuffer(rope.data[:at], np.uint8)]))
    else:
        leads = np.flatnonzero(_LEADS[np.frombuffer(rope.data, np.uint8)])
        at, chars = int(leads[rank]) if rank < len(leads) else rope.size, rank
        units = rope.units if at == rope.size else int(np.count_nonzero(_unit_ends(rope.data, False)[:at]))
    if at == rope.size:
        return rope, EMPTY
    return Rope(rope.data[:at], units, chars), Rope(rope.data[at:], rope.units - units, rope.chars - chars)


def find(rope: Rope, mark: bytes) -> int:
    """Code points before the first place of an ASCII ``mark``; -1 if there is none."""
    before, kept = 0, b""  # code points before ``kept``; the end of the leaves so far, in which a mark may begin
    for data in rope.leaves():
        here = kept + bytes(data)
        if (at := here.find(mark)) >= 0:
            return before + int(np.count_nonzero(_LEADS[np.frombuffer(here[:at], np.uint8)]))
        rest = here[max(0, len(here) - len(mark) + 1) :]
        before += int(np.count_nonzero(_LEADS[np.frombuffer(here[: len(here) - len(rest)], np.uint8)]))
        kept = rest
    return -1


def rearranged(rope: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle): the prefix ends after ``first`` units, the middle after ``second``."""
    if form == PLAIN:
        return rope, 0, 0
    prefix, rest = split(rope, first)
    middle, suffix = split(rest, second - first)
    p, s, m = (Rope(x, 1, len(x)) for x in SENTINELS)
    out = joined(p, prefix, s, suffix, m, middle) if form == PSM else joined(s, suffix, p, prefix, m, middle)
    return out, prefix.chars, middle.chars


def restored(rope: Rope, form: str) -> Rope:
    """The text that :func:`rearranged` made ``rope`` of; its parts hold no sentinel."""
    if form == PLAIN:
        return rope
    names = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
    parts, rest = {}, split(rope, len(names[0]), "chars")[1]
    for name, nxt in zip(names, names[1:], strict=False):
        parts[name], rest = split(rest, find(rest, nxt), "chars")
        rest = split(rest, len(nxt), "chars")[1]
    return joined(parts[PREFIX], rest, parts[SUFFIX])


def form_of(text: bytes, hashes: tuple[int, ...], percent: int = 50, spm_percent: int = 80) -> str:
    """Plain if the text is empty, holds a sentinel or is not drawn; else suffix or prefix first."""
    if not text or any(x in text for x in SENTINELS) or hashes[2] % 100 >= percent:
        return PLAIN
    return SPM if hashes[3] % 100 < spm_percent else PSM


def _hashes(key: str, seed: int) -> tuple[int, ...]:
    hexes = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(hexes[i : i + 8], 16) for i in range(0, 32, 8))


MADE = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (null if plain) and output.

    The cuts and the form are drawn from a hash of seed and id, so reruns and any
    partitioning agree; rows that repeat an id are cut at the same ranks.  A null id is
    hashed as no text.  Null and empty texts give n 0, form plain and an empty output;
    texts of white space are one unit.  A text that holds a sentinel stays plain.  Cuts at
    the same rank give an empty middle.  Texts are taken whole whatever their length; an
    empty table gives no rows.  Input columns of the made names are replaced; other names
    do not matter.
    """
    docs = docs.drop(*MADE)
    names, key, body = docs.columns, fresh(docs, "key"), fresh(docs, "body")
    given = docs.withColumn(key, F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).withColumn(body, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    schema = ", ".join(["n long", "form string", "prefix_chars long", "middle_chars long", "output string"])

    def made(batches):
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for k, t in zip(batch.column(len(names)).to_pylist(), as_binary(batch.column(len(names) + 1)).to_pylist(), strict=True):
                    h, rope = _hashes(k, seed), rope_of(t)
                    form = form_of(t, h, percent, spm_percent)
                    a, b = sorted((h[0] % (rope.units + 1), h[1] % (rope.units + 1)))
                    out, prefix, middle = rearranged(rope, a, b, form)
                    own = form != PLAIN
                    rows.append((rope.units, form, prefix if own else None, middle if own else None, bytes(out) if own else t))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(MADE)
                new = [pa.array(c, kind) for c, kind in zip(columns[:-1], list(MADE.values())[:-1], strict=True)]
                new.append(pa.array(columns[-1], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[*names, *MADE])

    return given.mapInArrow(made, _ddl(docs, schema))


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``df`` with ``restored``: the exact text, rebuilt from output and form alone; null outputs stay null."""
    df = df.drop("restored")
    names, body, how = df.columns, fresh(df, "body"), fresh(df, "how")
    given = df.withColumn(body, F.col(f"`{output}`").cast("string")).withColumn(how, F.col(f"`{form}`").cast("string"))

    def made(batches):
        for whole in batches:
            for batch in pieces(whole):
                both = zip(as_binary(batch.column(len(names))).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)
                back = [t if t is None or f in (PLAIN, None) else bytes(restored(rope_of(t), f)) for t, f in both]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(back, pa.binary()).cast(pa.string())], names=[*names, "restored"])

    return given.mapInArrow(made, _ddl(df, "restored string"))


def _ddl(df: DataFrame, more: str):
    """The schema of ``df`` with more columns."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def op12_infill(spark, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, with digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).drop("text")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS u,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS v,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(u, v)), '') AS p,
         array_to_string(list_slice(units, least(u, v) + 1, greatest(u, v)), '') AS m, array_to_string(list_slice(units, greatest(u, v) + 1, n), '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
