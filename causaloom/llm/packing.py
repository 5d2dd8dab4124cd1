"""Packing documents into sequences, shortest pack first over the length histogram.

Documents are tokenized once.  Whole sequences are cut off long documents; what remains
of every document is shorter than a sequence, so the histogram of the remainders has
fewer bins than a sequence has tokens, however many documents there are.  Over it runs
shortest-pack-first: lengths from the longest to the shortest, each into the shortest
open pack if it fits there, else into a new one, for all documents of a length at once;
what is kept are patterns with counts, not packs.  Then the shortest of the packs that
are not full are taken apart, and their documents, laid end to end, fill the room of the
others, being cut where a pack is full.  What is left in the end is less than a sequence
and goes to sequences of powers of two.  So no sequence is padded, and a document is cut
only there.

Patterns join documents by rank: the k-th document of a length (in the order of a hash
of the id) takes the k-th place that the patterns hold for it.  Ranks come from a range
partitioning of (length, hash, id), in which equal lengths are split among tasks;
only numbers a document travel there, and the driver sees a histogram and two numbers a
partition.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_WORDS, as_binary, pieces, stored

CAPACITY, END_ID = 2048, 1
#: Longer words are encoded each time and not remembered.
LONGEST_RUN = 64
#: Rows and bytes of texts that are cut at a time.
ROWS, BYTES = 256, 2_000_000


#: Characters of the texts that are cut here entirely; other words are left to the tokenizer whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[\\t-\\r -~{_LETTERS}]*")
#: Fixed values of the tokenizer file: contractions, letters, single digits, other signs.
_RUNS = f"[{_LETTERS}]+|'(?:[sStTmMdD]|[rRvV][eE]|[lL][lL])|[0-9]|[^\\t-\\r {_LETTERS}0-9]+"
_CUT = re.compile(_RUNS)
_CUT_MIXED = re.compile(f"(?<![^\\t-\\r ])[^\\t-\\r ]*(?:[^\\t-\\r -~{_LETTERS}]|<\\|)[^\\t-\\r ]*|{_RUNS}")
#: The characters by which the tokenizer file writes the bytes from 128 on: their own, or, if that does not show, the next ones from 256 + 34 on.
_SHOWN = [*range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: 290 + k for k, b in enumerate(b for b in range(0x80, 0x100) if b not in _SHOWN)}


def _cuts_alike(file: dict) -> bool:
    """Whether a tokenizer file lowers, cuts and writes plain words as is done here, so that its model can be asked for a run."""
    steps = lambda part: [(x["type"], (x.get("pattern") or {}).get("Regex"), x.get("add_prefix_space"), x.get("use_regex")) for x in (file[part] or {}).get(f"{part.replace('_', '')}s" if part != "normalizer" else "normalizers", [])]
    cut = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    lowered = [("NFC", None, None, None), ("Replace", r"\s+", None, None), ("Lowercase", None, None, None)]
    return steps("normalizer") == lowered and steps("pre_tokenizer") == [("Split", cut, None, None), ("ByteLevel", None, False, False)] and file["model"]["type"] == "BPE" and not file["model"]["dropout"]


class Ids(dict):
    """Token ids of words by a tokenizer that drops white space and case and looks at words one by one.

    Plain texts are split at white space; ids of words are remembered, so only what is new is
    cut into runs of letters, digits and signs, and only runs that are new are encoded, by the
    tokenizer's model where its file cuts as is done here.  A word with other letters or a special
    token is left to the tokenizer.  The memory starts afresh at CACHE_WORDS words, the generation before at hand.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.direct = self.tokenizer.model, _cuts_alike(json.loads(self.tokenizer.to_str()))
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.older: dict[str, bytes] = {}

    def of(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and the end id as little-endian numbers of ``kind``."""
        known, last = self.__getitem__, self._packed([end])
        return [b"".join(map(known, t.lower().split() if _PLAIN.fullmatch(t) and "<|" not in t else _CUT_MIXED.findall(t))) + last for t in texts]

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is None:
            ids = self._encoded(word)
        if len(word) <= LONGEST_RUN:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        if not self.direct or not _PLAIN.fullmatch(word) or "<|" in word:
            return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        runs = _CUT.findall(low)
        if len(runs) > 1:
            return b"".join([self[run] for run in runs])
        return self._packed([t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(_WRITTEN))])

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    """One for all tasks of a worker; a task begins and ends with an empty memory."""
    return Ids(path)


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, row, doc_id, n, ids) of every row, stored: ``part`` and ``row`` name a row, ids are 2 bytes each (4 if the vocabulary needs them)."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def made(batches):
        ids, part, row = _ids(tokenizer), TaskContext.get().partitionId(), 0
        size = np.dtype(ids.kind).itemsize
        ids.forget()
        for whole in batches:
            for batch in pieces(whole, ROWS, BYTES):
                found = ids.of(batch.column(1).to_pylist(), end_id)
                n = len(found)
                arrays = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column(0), pa.array([len(x) // size for x in found], pa.int64()), pa.array(found, pa.binary()), pa.array(np.full(n, size, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "row", "doc_id", "n", "ids", "id_bytes"])
                row += n
        ids.forget()

    return stored(given.mapInArrow(made, f"part int, row long, doc_id {dict(given.dtypes)['doc_id']}, n long, ids binary, id_bytes int"), "tokens")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns (packs, tokens of a pack, [(length, how often)]) for ``histogram`` (documents by length, all at most ``capacity``).

    A length enters the pack with the most room, one to each of the packs that share the
    pattern, as documents one by one would.  If it does not fit there it fits nowhere, and
    new packs take as many of it as they hold.  A length adds three patterns at most, so
    their number depends on the capacity only.
    """
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by room: (packs, (length, times, rest of the pattern))
    most = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while most and not open_[most]:
                most -= 1
            if most < size:
                each = capacity // size
                for packs, times in ((left // each, each), (1, left % each)):
                    if packs and times:
                        open_[capacity - times * size].append((packs, (size, times, None)))
                        most = max(most, capacity - times * size)
                break
            packs, pattern = open_[most].pop()
            taken = min(packs, left)
            if packs > taken:
                open_[most].append((packs - taken, pattern))
            last, times, rest = pattern
            open_[most - size].append((taken, (size, times + 1, rest) if last == size else (size, 1, pattern)))
            left -= taken
    out = []
    for room, groups in enumerate(open_):
        for packs, pattern in groups:
            items = []
            while pattern:
                items.append(pattern[:2])
                pattern = pattern[2]
            out.append((packs, capacity - room, items[::-1]))
    return out


@dataclass
class Places:
    """Where the documents of a length go, by their rank among them; a row is a run of ranks.

    ``size, first``: length and first rank.  ``times``: documents of the run a pack, 0 if
    they are laid end to end from token ``base`` on; else ``base`` is the sequence of the
    first pack and ``offset`` the place in it.  Rooms, by ascending ``start`` (the first
    of the tokens laid end to end that fills them): ``room`` tokens in each of a run of
    sequences from ``sequence`` on, from ``at`` on.
    """

    size: np.ndarray
    first: np.ndarray
    times: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    room: np.ndarray
    sequence: np.ndarray
    at: np.ndarray
    packs: int

    def find(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The run of each (length, rank)."""
        return np.searchsorted(self.key, (sizes.astype(np.int64) << 48) + ranks, side="right") - 1

    def __post_init__(self):
        self.key = (self.size << 48) + self.first

    def pieces_of(self, run: int, size: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of a document, in order."""
        k, times = rank - int(self.first[run]), int(self.times[run])
        if times:
            return [(size, int(self.base[run]) + k // times, int(self.offset[run]) + k % times * size)]
        out, token = [], int(self.base[run]) + k * size
        while size:
            r = int(np.searchsorted(self.start, token, side="right")) - 1
            pack, used = divmod(token - int(self.start[r]), int(self.room[r]))
            taken = min(size, int(self.room[r]) - used)
            out.append((taken, int(self.sequence[r]) + pack, int(self.at[r]) + used))
            token, size = token + taken, size - taken
        return out


def places(histogram: dict[int, int], capacity: int) -> Places:
    """Runs of ranks and rooms for a histogram of lengths below ``capacity``."""
    patterns = sorted(shortest_pack_first(histogram, capacity), key=lambda p: (-p[1], p[2]))
    tokens = sum(packs * total for packs, total, _ in patterns if total < capacity)
    kept, tail = divmod(tokens, capacity)  # so many of the packs that are not full will be; the rest fills them
    runs, rooms, ranks, sequence, laid, filled = [], [], dict.fromkeys(histogram, 0), 0, 0, 0

    def taken(size: int, n: int) -> int:
        ranks[size] += n
        return ranks[size] - n

    for packs, total, items in patterns:
        stay = packs if total == capacity else min(packs, kept)
        if total < capacity:
            kept -= stay
        if stay:
            offset = 0
            for size, times in items:
                runs.append((size, taken(size, stay * times), times, sequence, offset))
                offset += size * times
            if total < capacity:
                rooms.append((filled, capacity - total, sequence, total))
                filled += stay * (capacity - total)
            sequence += stay
        for size, times in items if packs > stay else ():
            n = (packs - stay) * times
            runs.append((size, taken(size, n), 0, laid, 0))
            laid += n * size
    for bit in reversed(range(capacity.bit_length())):
        if tail >> bit & 1:
            rooms.append((filled, 1 << bit, sequence, 0))
            filled, sequence = filled + (1 << bit), sequence + 1
    assert filled == laid
    as_arrays = lambda rows, n: np.array(rows, np.int64).reshape(-1, n).T
    return Places(*as_arrays(sorted(runs), 5), *as_arrays(rooms, 4), packs=sequence)


def ranked(tokens: DataFrame, capacity: int) -> DataFrame:
    """(part, row, size, full, p, i, full_before): remainder and whole sequences of a row, its place i in task p and the sum of ``full`` there before it; stored.

    Rows are in the order (size, hash of the id, id, checksum of the ids, number) over all tasks.
    """
    order = ["size", "hash", "doc_id", "n", "mark", "part", "row"]
    meta = tokens.select("part", "row", "doc_id", "n", (F.col("n") % capacity).alias("size"), F.xxhash64("doc_id").alias("hash"), F.crc32("ids").alias("mark"))
    placed = meta.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "row", "size", F.expr(f"n div {capacity}").alias("full"))

    def made(batches):
        p, i, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            own = batch.column(3).to_numpy()
            n, before = len(own), full + np.cumsum(own) - own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, p, np.int32)), pa.array(np.arange(i, i + n)), pa.array(before.astype(np.int64))], names=["part", "row", "size", "full", "p", "i", "full_before"])
            i, full = i + n, full + int(own.sum())

    return stored(placed.mapInArrow(made, "part int, row long, size long, full long, p int, i long, full_before long"), "ranks")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the pieces of all documents; ids are little-endian uint32.

    ``tokenizer`` is a file that the workers can read, of a tokenizer whose words are cut
    at white space.  A document is its ids and ``end_id``; null and empty texts are the
    end id alone.  Sequences hold ``capacity`` tokens, but for fewer than
    log2(capacity) + 1 of a power of two.  Rows that repeat an id or a text are packed
    each, null ids too; ties in the order of ids are broken by the ids' checksum and then
    by where a row was read, so only equal rows may swap their places between reruns.
    Texts are taken whole whatever their length.  An empty table gives no rows.  Only
    the two named columns are read, so other names do not matter.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    tokens = tokenized(docs, tokenizer, doc_id, text, end_id)
    rows = ranked(tokens, capacity)
    histogram = {r.size: r.n for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row a length
    tasks = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # a row a task
    firsts = np.zeros((max((r.p for r in tasks), default=-1) + 2, 2), np.int64)
    for r in tasks:
        firsts[r.p + 1] = r.n, r.full
    firsts = np.cumsum(firsts, axis=0)
    lengths = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        lengths[size + 1] = n
    before = np.cumsum(lengths)
    where = places({s: n for s, n in histogram.items() if s}, capacity)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def made(batches):
        for whole in batches:
            for batch in pieces(whole):
                c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                number = {name: c[name].to_numpy() for name in ("n", "id_bytes", "size", "full", "p", "i", "full_before")}
                rank = firsts[number["p"], 0] + number["i"] - before[number["size"]]
                run = where.find(number["size"], rank).tolist()
                sequence = (where.packs + firsts[number["p"], 1] + number["full_before"]).tolist()
                out: list[tuple] = []
                each = zip(as_binary(c["ids"]).to_pylist(), number["id_bytes"].tolist(), number["size"].tolist(), number["full"].tolist(), rank.tolist(), strict=True)
                for k, (data, width, size, full, its_rank) in enumerate(each):
                    ids = data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()
                    cut = [(capacity, sequence[k] + j, 0) for j in range(full)] + (where.pieces_of(run[k], size, its_rank) if size else [])
                    start = 0
                    for length, its_sequence, offset in cut:
                        out.append((k, start, length, ids[4 * start : 4 * (start + length)], its_sequence, offset))
                        start += length
                if not out:
                    continue
                row, start, length, ids, its_sequence, offset = zip(*out, strict=True)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([c["doc_id"].take(row), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), c["n"].take(row), pa.array(its_sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    return tokens.join(rows, ["part", "row"]).mapInArrow(made, f"doc_id {dict(tokens.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, ids): every sequence put together from its pieces."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", "n_tokens", "n_pieces", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; the checksum of each piece's ids instead of these."""
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
