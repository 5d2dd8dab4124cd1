"""Vector codes, fill-in-middle and packing against plain versions of their rules."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from causaloom.llm import infill, packing, vector_codes
from causaloom.llm.entries import oracle_sql, queries

VECTORS = "vec_id long, embedding array<float>, label int"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error, label_error)} and the codebooks, with Python's integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda a, book: min(range(len(book)), key=lambda j: (far(a, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[best(cut(v, p), books[p])].append(cut(v, p))
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    codes = {i: [best(cut(v, p), books[p]) for p in range(parts)] for i, v, _ in kept}
    error = {i: sum(far(cut(v, p), books[p][codes[i][p]]) for p in range(parts)) for i, v, _ in kept}
    total = collections.Counter()
    for i, _, label in kept:
        total[label] += error[i]
    return {i: ("".join(f"{c:02x}" for c in codes[i]), error[i], total[label]) for i, _, label in kept}, books


def vectors(n=70, dimension=16, seed=1):
    r = random.Random(seed)
    rows = [(i * 3, [float(np.float32(r.gauss(0, 0.3))) for _ in range(dimension)], r.choice([None, 1, 2])) for i in range(n)]
    rows[40:45] = [(i, rows[0][1], label) for i, _, label in rows[40:45]]  # copies of a vector that starts a codebook
    rows[5] = (15, rows[4][1], 1)  # equal entries: ties
    return rows + [(1, None, 1), (2, [0.1] * 15 + [None], 1), (4, [0.1] * 15 + [float("nan")], 2), (5, [float("inf")] * dimension, 2), (7, [0.0] * dimension, 2), (8, [0.5 / 4096] * dimension, None)]


def test_codes_against_brute_force(spark):
    rows = vectors()
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("code", F.lit("x")).withColumn("n", F.lit(1)).withColumn("data", F.lit(2))
    got, books = vector_codes.compress_vectors(df)
    want, its_books = brute_codes(rows)
    assert books.tolist() == its_books
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got.collect()} == want
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in its_books for e in b for x in e).encode()).hexdigest()


def test_codes_of_few_repeated_and_no_vectors(spark):
    few = [(9, [1.0] * 8, None), (3, [-0.5] * 8, None), (3, [-0.5] * 8, None), (None, [2.0] * 8, 5)]
    got, books = vector_codes.compress_vectors(spark.createDataFrame(few, VECTORS))
    assert books.shape == (8, 4, 1) and books[:, :, 0].tolist() == [[-2048, -2048, 4096, 8192]] * 8
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in got.collect()) == [(0, "03" * 8, 0, 0), (3, "00" * 8, 0, 0), (3, "00" * 8, 0, 0), (9, "02" * 8, 0, 0)]
    got, books = vector_codes.compress_vectors(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 8, 1)], VECTORS))
    assert books is None and got.count() == 0
    with pytest.raises(ValueError, match="divide"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1.0] * 7, 1)], VECTORS))


def test_nearest_is_exact_where_float32_is_not():
    """Entries whose distances differ by one, far beyond the 24 bits of a float32."""
    r = np.random.default_rng(4)
    for _ in range(20):
        x = r.integers(-(1 << 26), 1 << 26, (300, 8)).astype(np.int32)
        base = r.integers(-(1 << 26), 1 << 26, 8)
        entries = base + r.integers(-2, 3, (16, 8))
        entries[7] = entries[3]
        want = [min(range(16), key=lambda j: (sum((int(a) - int(b)) ** 2 for a, b in zip(row, entries[j], strict=True)), j)) for row in x]
        assert vector_codes.nearest(x, entries).tolist() == want


def test_codes_restore_vectors():
    r = np.random.default_rng(5)
    books, x = r.integers(-50, 50, (4, 6, 3)), r.integers(-60, 60, (100, 12)).astype(np.int32)
    codes = vector_codes.assigned(x, books)
    back = vector_codes.decoded(codes, books)
    assert (vector_codes.errors(x, books, codes) == ((x - back) ** 2).sum(axis=1)).all()
    assert vector_codes.hex_codes(codes)[0] == "".join(f"{c:02x}" for c in codes[0])


# --- fill-in-middle


def brute_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def noise(r, n):
    return "".join(r.choice(["a", "é", "漢", "😀", " ", "\n", "\t", "\x0b", " ", "<", "P", ">", "S", "M", "word"]) for _ in range(n))


def test_infill_against_plain_rule(spark):
    r = random.Random(6)
    rows = [(i, noise(r, r.randint(0, 200))) for i in range(300)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "x" * 300_000 + " é" * 100_000), (None, noise(r, 50)), (7, "same id"), (7, "same id"), (1004, "in <S> it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit(3)).withColumn("key", F.lit("k")).withColumn("_key", F.lit("k"))
    made = infill.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "key", "_key", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = infill.restore(made).collect()
    assert len(got) == len(rows) and {x.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == brute_infill(x.doc_id, x.text)
        assert x.restored == (x.text or "")
    assert infill.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_ropes_of_small_leaves(leaf):
    r = random.Random(leaf)
    for _ in range(300):
        text = noise(r, r.randint(0, 60))
        units, rope = UNIT.findall(text), infill.rope_of(text.encode(), leaf)
        assert (rope.units, rope.chars, bytes(rope)) == (len(units), len(text), text.encode())
        k, c = r.randint(0, len(units) + 1), r.randint(0, len(text) + 1)
        assert tuple(bytes(x).decode() for x in infill.split(rope, k)) == ("".join(units[:k]), "".join(units[k:]))
        left, right = infill.split(rope, c, "chars")
        assert (bytes(left).decode(), bytes(right).decode()) == (text[:c], text[c:]) and left.chars + right.chars == rope.chars and left.units + right.units == rope.units
        assert infill.find(rope, b"<S>") == text.find("<S>")


# --- packing


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def held(pieces, capacity):
    """Checks the places of pieces; {sequence: tokens}."""
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return {k: sum(n for _, n in v) for k, v in by.items()}


@pytest.mark.parametrize("capacity", [1, 16, 2048])
def test_packing_against_the_tokenizer(spark, capacity):
    from tokenizers import Tokenizer

    path, r = tokenizer(), random.Random(8)
    rows = [(i, " ".join(r.choice(["Alpha", "beta's", "漢字", "x1y2", "<|endoftext|>", "É", " z"]) for _ in range(r.choice([1, 3, 40, 41])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "long words " * 4000), (None, "no id"), (None, "no id"), (504, "q" * 3000)] + [(600, "copy of one text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("length", F.lit("x")).withColumn("n", F.lit(0)).withColumn("size", F.lit(0))
    packed = packing.pack_documents(df, path, capacity=capacity)
    got, encoder = packed.collect(), Tokenizer.from_file(path)
    sizes = held(got, capacity)
    assert sum(n < capacity for n in sizes.values()) <= capacity.bit_length()
    want = collections.Counter()
    for i, t in rows:
        want[i, tuple(encoder.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    tokens = sum(len(t) * n for (_, t), n in want.items())
    assert sum(sizes.values()) == tokens
    # the pieces of an id, put together by start, hold the ids of its documents, each as often as it comes
    found = collections.Counter((p.doc_id, p.start, p.doc_tokens, p.ids) for p in got)
    for (i, ids), n in want.items():
        starts = sorted({(p.start, p.length) for p in got if p.doc_id == i and p.doc_tokens == len(ids)})
        if n == 1 and sum(1 for k in want if k[0] == i) == 1:
            assert [s for s, _ in starts] == np.cumsum([0] + [k for _, k in starts])[:-1].tolist()
            assert b"".join(d for _, _, _, d in sorted((k for k in found if k[0] == i and k[2] == len(ids)), key=lambda k: k[1])) == np.array(ids, "<u4").tobytes()
        total = sum(len(d) * c for (j, _, m, d), c in found.items() if j == i and m == len(ids)) // 4
        assert total == sum(len(t) * c for (j, t), c in want.items() if j == i and len(t) == len(ids))
    whole = {r.sequence_id: r for r in packing.sequences(packed.checkpoint()).collect()}
    assert {k: (v.n_tokens, len(v.ids)) for k, v in whole.items()} == {k: (n, 4 * n) for k, n in sizes.items()}


def test_plain_words_are_asked_of_the_model_and_once():
    """Only words with other letters or a special token go through the whole tokenizer."""
    ids, r, asked = packing.Ids(tokenizer()), random.Random(11), []
    whole, model = ids.tokenizer, ids.model

    class Recorded:
        def encode(self, text, **kw):
            asked.append(text)
            return whole.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    class Model:
        def tokenize(self, run):
            asked.append((run,))
            return model.tokenize(run)

    ids.tokenizer, ids.model = Recorded(), Model()
    texts = ["".join(r.choice("abXYÉéßıſŉÿ29'\"!?.,_/<> \t") for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["odd 漢字 word, <|endoftext|>", "plain plain"]
    got = ids.of(texts, 1) + ids.of(texts, 1)
    want = [np.array(e.ids + [1], "<u2").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want + want
    assert [a for a in asked if isinstance(a, str)] == ["漢字", "<|endoftext|>"]
    assert len(asked) == len(set(asked))


def test_packing_of_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer()).count() == 0


def test_patterns_hold_every_document_and_leave_little_room():
    r = random.Random(9)
    for _ in range(200):
        capacity = r.choice([2, 7, 16, 100])
        histogram = {r.randint(1, capacity - 1): r.choice([1, 2, 5, 333]) for _ in range(r.randint(0, 12))}
        patterns, got = packing.shortest_pack_first(histogram, capacity), collections.Counter()
        for packs, total, items in patterns:
            assert total == sum(a * b for a, b in items) <= capacity
            for size, times in items:
                got[size] += packs * times
        assert got == histogram and len(patterns) <= 3 * max(1, len(histogram))
        # as documents one by one, longest first, each into the shortest pack if it fits there
        one_by_one: list[int] = []
        for size in sorted(histogram, reverse=True):
            for _ in range(histogram[size]):
                if one_by_one and min(one_by_one) + size <= capacity:
                    one_by_one[one_by_one.index(min(one_by_one))] += size
                else:
                    one_by_one.append(size)
        assert sorted(one_by_one) == sorted(t for n, t, _ in patterns for _ in range(n))
    hot = packing.shortest_pack_first({1: 10**12, 700: 10**11, 2047: 5}, 2048)
    assert len(hot) < 20 and sum(n * t for n, t, _ in hot) == 10**12 + 700 * 10**11 + 2047 * 5
    assert packing.places({1: 10**12, 700: 10**11, 2047: 5}, 2048).packs <= (10**12 + 700 * 10**11 + 2047 * 5) / 2048 + 12


# --- queries


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_infill"])
def test_query_against_its_sql(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir).toPandas()
    with duckdb.connect() as db:
        for t in ("embeddings", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.execute(oracle_sql()[name]).df()
    key = got.columns[0]
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x[sorted(x.columns)].sort_values(key).astype(object).where(x[sorted(x.columns)].sort_values(key).notna(), None) for x in (got, want))
    assert got.values.tolist() == want.values.tolist()


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got, encoder = queries()["op13_packing"](spark, sf_dir).collect(), Tokenizer.from_file(tokenizer())
    held(got, 2048)
    own = collections.defaultdict(list)
    for p in got:
        own[p.doc_id].append(p)
    assert own.keys() == docs.keys()
    for i, pieces in own.items():
        ids, at = np.array(encoder.encode(docs[i] or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
