"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing columns; brute-force versions beside them."""

import collections
import hashlib
import html
import math
import random
import re
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causaloom.llm import decontam, html_text, labelled, line_dedup, lm_score, mixing, ngram_join, quality, toxicity, vector_dedup, warc
from causaloom.llm.components import components

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(120)
    words = base.split()
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(words[:60] + ["xx"] + words[61:]), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, "  \n ", "en", "", 3),
            (7, "One two", "en", "a", 7), (8, "one TWO", "en", "a", 7), (9, prose(9000), "en", "a", 1), (10, base, "en", None, 1), (10, base, "en", None, 1), (None, prose(30), "en", "c", 1)]
    rows += [(100 + i, prose(40 + i), "en", "abc"[i % 3], 1) for i in range(40)]
    return table(spark, rows).withColumn("leaks", F.lit(1)).withColumn("score", F.lit("x")).cache()


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 31)} | {100 + i: 100 for i in range(50)}


# --- n-gram join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                r, s = find(a), find(b)
                up[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_against_brute_force(spark, docs):
    got = ngram_join.similar_documents(docs).collect()
    assert len(got) == docs.count()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert {r.doc_id: r.component_id for r in got}[3] == 1


def test_ngram_join_finds_links_between_groups(spark):
    """Variants of few texts at all distances around the threshold, so that groups must be opened."""
    rng, rows = random.Random(11), []
    for _ in range(6):
        words = [rng.choice(WORDS) for _ in range(60)]
        for _ in range(25):
            copy = list(words)
            for at in rng.sample(range(60), rng.randint(0, 4)):
                copy[at] = rng.choice(WORDS)
            rows.append((len(rows) + 1, " ".join(copy[rng.randint(0, 6) :]), "en", "a", 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table(spark, rows)).collect()}
    assert got == brute_components([(r[0], r[1]) for r in rows])


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.similar_documents(table(spark, [])).count() == 0


def test_first_tokens_of_links_meet():
    """A common token is among the first ones of both sets of a link, and leads in the smaller."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        low = int(rng.integers(1, 90))
        high = int(rng.integers(low, low * 100 // ngram_join.PERCENT + 1))
        common = int(rng.integers(min(low, -(-(low + high) * ngram_join.PERCENT // (100 + ngram_join.PERCENT))), low + 1))
        order = rng.permutation(low + high - common)  # places of all tokens in the common order
        a, b = np.sort(order[:low]), np.sort(order[low - common :])
        if 100 * common < ngram_join.PERCENT * (low + high - common):
            continue
        first = min(set(a.tolist()) & set(b.tolist()))
        others = {i: int(rng.integers(common, len(s) + 1)) for i, s in enumerate((a, b))}  # tokens that some other set has
        for i, (s, place) in enumerate(((a, lambda f: f[1]), (b, lambda f: f[0]))):
            alone = len(s) - others[i]
            assert np.searchsorted(s, first) < place(ngram_join.first_tokens(len(s), others[i])) + alone


def test_ngram_join_links_at_the_threshold_without_hubs(spark, monkeypatch):
    """Sets of 19 and 20 shingles with 17 in common, found by the matrix alone."""
    monkeypatch.setattr(ngram_join, "_hub_links", lambda able: (None, None))
    rng, rows = random.Random(21), []
    for i in range(150):
        words = [f"{rng.randrange(10**9)}" for _ in range(24)]
        rows += [(2 * i, " ".join(words), "en", "a", 1), (2 * i + 1, " ".join([*words[:21], "x", "y"]), "en", "a", 1)]
    got = ngram_join.similar_documents(table(spark, rows)).collect()
    assert {r.n_shingles for r in got} == {19, 20}
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


@pytest.mark.parametrize("hubs", [True, False])
def test_ngram_join_of_one_large_group_of_near_copies(spark, monkeypatch, hubs):
    """Near copies on both sides of the threshold in small groups, some tokens in every document, and some texts very frequent."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    monkeypatch.setattr(ngram_join, "PACKED", 500)
    monkeypatch.setattr(ngram_join, "SAMPLED", 1)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 4)
    if not hubs:
        monkeypatch.setattr(ngram_join, "_hub_links", lambda able: (None, None))
    rng = random.Random(17)
    words, passage = [rng.choice(WORDS) for _ in range(80)], [rng.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(160):
        copy = list(words) if i % 4 else [rng.choice(WORDS) for _ in range(rng.randint(3, 25))] + passage
        for at in rng.sample(range(len(copy)), rng.randint(0, 5) if i % 4 else 1):
            copy[at] = rng.choice(WORDS)
        rows.append((500 - i, " ".join(copy), "en", "a", 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table(spark, rows)).collect()}
    want = brute_components([(r[0], r[1]) for r in rows])
    assert got == want
    assert len({c for _, c in want.values()}) > 20


def test_ngram_join_keeps_one_row_of_a_group(spark):
    """Null and repeated ids: rows count by their texts."""
    a, b, c = prose(50), prose(50), prose(50)
    rows = [(None, a, "en", "a", 1), (None, a, "en", "a", 1), (7, a, "en", "a", 1), (7, b, "en", "a", 1), (8, b, "en", "a", 1), (None, c, "en", "a", 1), (None, c, "de", "b", 2), (9, "", "en", "a", 0), (9, "", "en", "a", 0)]
    got = ngram_join.similar_documents(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == sorted(
        [(0, 7, False), (0, 7, False), (7, 7, True), (7, 7, True), (8, 7, False), (0, 0, True), (0, 0, True), (9, 9, True), (9, 9, True)]
    )


# --- mixing


def test_mixing_targets_and_words(spark, docs):
    got = mixing.mix_sources(docs.withColumn("target", F.lit(0))).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    size, weight = {s: sum(r["size"] for r in by[s]) for s in names}, {s: 1 + i % 3 for i, s in enumerate(names)}
    stopped = {}
    while True:
        left, free = sum(size.values()) - sum(stopped.values()), [s for s in names if s not in stopped]
        goal = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 3 * size[s]]
        if not over:
            break
        stopped |= {s: 3 * size[s] for s in over}
    for s in names:
        assert by[s][0].target == pytest.approx((goal | stopped)[s]) and by[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in by[s]) - by[s][0].target) <= 2
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken, r.shards) for r in again) == sorted((str(r.doc_id), r.taken, r.shards) for r in got)


def test_mixing_of_an_empty_table(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_hypergeometric_follows_its_distribution(spark):
    n = 4000
    draws = spark.range(n).select(mixing.hypergeometric((F.col("id") + 0.5) / n, F.lit(12), F.lit(20), F.lit(9)).alias("k")).groupBy("k").count().collect()
    for r in draws:
        want = math.comb(12, r.k) * math.comb(20, 9 - r.k) / math.comb(32, 9)
        assert r["count"] / n == pytest.approx(want, abs=2e-3)


def test_hypergeometric_of_large_counts(spark):
    n, good, bad, draws = 2000, 150_000, 400_000, 90_000
    got = [r.k for r in spark.range(n).select(mixing.hypergeometric((F.col("id") + 0.5) / n, F.lit(good), F.lit(bad), F.lit(draws)).alias("k")).collect()]
    share = good / (good + bad)
    assert np.mean(got) == pytest.approx(draws * share, abs=1)
    assert np.std(got) == pytest.approx(math.sqrt(draws * share * (1 - share) * (good + bad - draws) / (good + bad - 1)), rel=0.02)
    some = spark.range(1).select(*[mixing.hypergeometric(F.lit(0.5), F.lit(g), F.lit(b), F.lit(d)).alias(f"x{i}") for i, (g, b, d) in enumerate([(0, 5, 3), (5, 0, 3), (0, 0, 0), (4, 4, 8), (7, 2, 0)])]).first()
    assert list(some) == [0, 3, 0, 4, 0]


def test_mixing_of_repeated_and_null_ids_with_clashing_names(spark):
    """600 rows on 100 ids, and half of the ids null: every row is drawn as itself."""
    rows = [(None if i % 2 else i % 100, prose(1 + i % 9), "en", "abc"[i % 3], 1) for i in range(600)] + [(7, prose(5), "en", "a", 1)] * 3
    d = table(spark, rows).withColumnsRenamed({"lang": "draws", "n_chars": "part"}).withColumns({c: F.lit(1) for c in ("docs", "rest", "n_blocks", "row", "key", "p_source")})
    out = mixing.mix_sources(d, block_docs=8)
    assert out.columns[: len(d.columns)] == d.columns
    by = collections.defaultdict(list)
    for r in out.collect():
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    assert sum(map(len, by.values())) == len(rows)
    for got in by.values():
        assert abs(sum(r.taken for r in got) - got[0].target) <= 4


def test_split_quotas_are_exact(spark):
    quotas = spark.createDataFrame([("a", 37), ("b", 5), (None, 0), ("c", 1000)], "source string, blocks long")
    got = mixing.split_quotas(quotas, levels=3).collect()
    sums, shards = collections.Counter(), collections.Counter()
    for r in got:
        assert r.blocks >= 0
        sums[r.source] += r.blocks
        shards[r.shard] += r.blocks
    assert sums == {"a": 37, "b": 5, None: 0, "c": 1000} and max(shards.values()) - min(shards.values()) <= 1


# --- line dedup


def test_line_dedup(spark):
    rows = [(i, f"text {i}\n  Same line \nSame line\n\nend{i}", "en", "h", 1) for i in range(10)] + [(20, "Same line", "en", "h", 1), (21, None, "en", "h", 1), (22, "", "en", None, 0), (23, "Same line\nx", "en", "other", 1)]
    d = table(spark, rows).withColumn("lines_dropped", F.lit("mine"))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(d, ratio=0.5, prior=0).collect()}
    assert len(got) == len(rows) and got[3].text == "text 3\n\nend3" and got[3].lines_dropped == 2
    assert got[20].text == "" and got[21].text is None and got[22].text == "" and got[23].text == "Same line\nx"
    assert line_dedup.drop_boilerplate(table(spark, [])).count() == 0


def test_line_dedup_by_document_gives_the_same(spark, docs, monkeypatch):
    d = table(spark, [(i, f"a{i}\nSame\nb", "en", "h", 1) for i in range(20)])
    want = sorted((r.doc_id, r.text, r.lines_dropped) for r in line_dedup.drop_boilerplate(d).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted((r.doc_id, r.text, r.lines_dropped) for r in line_dedup.drop_boilerplate(d).collect()) == want


def test_line_dedup_of_passages_copies_and_clashing_names(spark, monkeypatch):
    """A long passage on a hot source goes at a lower share; copies of a page count once; short lines on few pages stay."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own {i}\n{passage if i % 100 == 0 else i}\n{'Share this' if i % 50 == 0 else -i}\n{'rare' if i < 10 else i / 2}", "en", "hot", 1) for i in range(1500)]
    rows += [(9000 + i, "copied page\nof two lines", "en", "hot", 1) for i in range(300)]
    d = table(spark, rows).withColumnsRenamed({"lang": "_bad", "n_chars": "_host"}).withColumn("_page", F.lit(1)).withColumn("_kept", F.lit(2))
    for most in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        out = line_dedup.drop_boilerplate(d)
        assert out.columns == [*d.columns, "lines_dropped"]
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == len(rows) and got[9000].lines_dropped == 0
        assert got[100].text == "own 100\n50.0" and got[7].text == "own 7\n7\n-7\nrare" and got[100].lines_dropped == 2


# --- decontamination


def best_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, prose(rng.randint(5, 40), rng)) for k in range(8)] + [(90, "of the"), (91, None), (None, "x y z a b c"), (92, "")]
    rows, kinds = [], [0, 0, 1, 2, 3, 5, 9, 20]
    for i in range(120):
        words = prose(rng.randint(0, 150), rng).split()
        if i % 3:
            item = items[i % 8][1].split()
            for _ in range(min(kinds[i % 8], len(item) // 3)):
                at = rng.randrange(len(item))
                rng.choice([lambda: item.__setitem__(at, "zz"), lambda: item.insert(at, "qq"), lambda: item.pop(at)])()
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," if rng.random() < 0.1 else w for w in item]
        rows.append((i, " ".join(words), "en", "a", 1))
    rows += [(900, None, "en", "a", 1), (901, "", "en", "a", 1), (902, "-- !!", "en", "a", 1)]
    got = {r.doc_id: {x["item_id"]: x["edits"] for x in r.leaks} for r in decontam.find_leaks(table(spark, rows).withColumn("leaks", F.lit(3)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    true = found = 0
    for i, text, *_ in rows:
        words = re.sub(r"[^a-z ]", "", (text or "").lower()).split()
        for k, item in items[:8]:
            item = item.split()
            edits = best_edits(item, words) if words else len(item)
            if edits <= int(0.2 * len(item)):
                true += 1
                found += got[i].get(k) == edits
                if edits == 0:
                    assert got[i].get(k) == 0
            else:
                assert k not in got[i]
    assert true > 40 and found >= 0.95 * true
    assert got[900] == got[901] == got[902] == {}
    pieces = decontam.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), items=4)
    assert {r.doc_id: {x["item_id"]: x["edits"] for x in r.leaks} for r in pieces.collect()} == got
    assert decontam.find_leaks(table(spark, rows), spark.createDataFrame([], "item_id long, text string")).filter("size(leaks) > 0").count() == 0
    assert decontam.find_leaks(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_bit_sampling_reaches_items_with_edits():
    rng = random.Random(11)
    items = [(k, prose(rng.randint(12, 60), rng).encode()) for k in range(60)]
    index = decontam.ItemIndex(items)
    for share, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.92)):
        texts = []
        for _, text in items:
            words = text.decode().split()
            for _ in range(int(share * len(words))):
                at = rng.randrange(len(words))
                rng.choice([lambda: words.__setitem__(at, "zz"), lambda: words.insert(at, "qq"), lambda: words.pop(at)])()
            texts.append(decontam.cores_of(f"{prose(rng.randint(0, 30), rng)} {' '.join(words)} {prose(rng.randint(0, 30), rng)}".encode(), decontam.CoreHash()))
        found = [any(m[0] == k for m in of) for k, of in enumerate(index.matches(texts))]
        assert sum(found) >= least * len(items)


def test_every_stretch_of_an_item_holds_a_window():
    for n in range(1, 300):
        size, stride = decontam.window_size(n)
        assert 0 < size <= n and size + stride - 1 <= max(n, 1) and 2 * size > n


# --- classifiers


def test_toxicity_learns_words_and_pairs(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        words = prose(rng.randint(5, 60), rng).split()
        kind = i % 4
        if kind == 1:
            words.insert(rng.randint(0, len(words)), "blarghs")
        if kind in (2, 3) and rng.random() < 0.5:
            words.insert(0, "snarky")
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int("blarghs" in words)))
    rows += [(9000, None, None, None, None), (9001, "", "en", "a", 0), (None, "blarghs", "en", "a", 0), (9000, "Blarghs!", "en", "a", 0)]
    labels += [(0, None, None), (None, 1, 1), (1, 0, 0)]
    d, lab = table(spark, rows).withColumn("toxicity", F.lit("mine")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit_toxicity(d, lab)
    got = toxicity.score_toxicity(d, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.toxic_predicted == int("blarghs" in r.text.split()) for r in held)
    assert [r for r in got if r.text == ""][0].toxic_predicted == 0
    none = toxicity.fit_toxicity(d, lab.filter("toxic = 0"))
    assert toxicity.score_toxicity(d, none).filter("toxic_predicted = 1").count() == 0


def test_factorization_machine_learns_an_interaction():
    """Neither term alone decides, only both together."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = (rng.random(2) < 0.5).tolist()
        rows.append(np.unique([11] * a + [22] * b + [int(x) for x in rng.integers(100, 400, 4)]))
        y.append(float(a and b))
    m = toxicity.FactorizationMachine.fit(rows, np.array(y))
    assert m.score(np.array([11, 22])) > 0.7 > 0.5 > max(m.score(np.array([11])), m.score(np.array([22])))


def test_labelled_sample_bound_and_fold(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 140)], "doc_id long, quality int, toxic int")
    got = labelled.labelled_sample(docs, labels, "quality", 5, 0, 12).select("doc_id").distinct().collect()
    assert len(got) <= 12 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_quality(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(300):
        text = prose(rng.randint(20, 90), rng)
        good = i % 3 != 0
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "en", "a", 1))
        labels.append((i, int(good), 0))
    rows += [(900, None, "en", "a", 1), (901, "", "en", "a", 1), (None, "ab", "en", "a", 1)]
    d, lab = table(spark, rows).withColumn("quality_score", F.lit(9)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    vectors, network = quality.fit_quality(d, lab)
    got = quality.score_quality(d, vectors, network).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.quality_predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    again = quality.word_vectors(d.repartition(5))
    assert all(np.array_equal(a, b) for a, b in zip(vectors, again, strict=True))
    assert quality.word_vectors(table(spark, []))[0].shape == (quality.WORDS, quality.DIMENSIONS)


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site <b>head</b></header><nav><a href="/x">menu</a></nav>
<div class="cookie-notice">We use cookies</div><div class="layout"><aside class="sidebar">side text that is long enough to count as text</aside>
<div class="post-{n} entry"><h1>Title &amp; more</h1><p>First <b>bold</b>ed para&shy;graph number {n}.<p>Second<br>para with <a href="#">a link</a> &lt;tag&gt;</div>
<div class="ad-box ads">Buy now</div><form><label>Mail</label><input></form><section id="comments"><p>Reader says hello</p></section></div><footer>&copy; foot</footer></body></html>"""


def test_html_consensus_paths(spark):
    rows = [(i, f"http://Site.example/{i}", PAGE.replace("{n}", str(i))) for i in range(12)] + [(50, None, None), (51, "x", ""), (52, "http://other.example", "<p>only <i>text"), (53, "http://site.example/z", "<html><body><article><p>Odd page</p></article></body></html>"), (54, "http://c.example", "plain text &eacute;  here"), (55, "http://d.example", "<article><p>cut in a tag</p><p cla")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit(1))
    got = {r.page_id: r.main_text for r in html_text.extract_main_text(d).collect()}
    assert got[3] == html.unescape("Title & more First bolded para&shy;graph number 3. Second para with a link <tag>")
    assert (got[50], got[51], got[52], got[53], got[54], got[55]) == ("", "", "only text", "Odd page", "plain text é here", "cut in a tag")
    assert [r.path for r in html_text.host_paths(d.filter("page_id < 12")).collect()] == ["/html/body/div.layout/div.entry.post-#"]
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_of_names_that_only_look_like_boilerplate():
    page = '<html><body><div class="site-nav">menu</div><article class="article-comments-off"><p>One.</p><ul class="share-capital"><li>two</li></ul><div class="form-factor">three</div><p class="notice-period">four</p><div class="post-comments"><p>a comment</p></div><div class="share-buttons">share</div></article></body></html>'
    assert html_text.main_text(page, None) == "One. two three four"


def test_html_of_deep_pages_and_clashing_names(spark):
    deep = "<div>" * 20_000 + "<p>inside</p>" + "</span>" * 40_000
    assert sum(len(c[0]) for c in html_text.parse(deep)[0]) < 30_000_000
    d = spark.createDataFrame([(1, "http://a.example/x", deep, 5, 6), (1, "http://a.example/x", deep, 5, 6)], "page_id long, url string, html string, _host int, _path int")
    out = html_text.extract_main_text(d)
    assert out.columns == ["page_id", "url", "_host", "_path", "main_text"]
    assert [tuple(r) for r in out.collect()] == [(1, "http://a.example/x", 5, 6, "inside")] * 2


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(i, f"http://h.example/{i % 3}", f"<p>{i}</p>") for i in range(30)] + [(100, "http://a.example/?q=1\n2", big), (101, None, big), (102, "http://a.example", big + "x"), (103, "u", None), (104, "u", ""), (105, "u", "small"), (106, "u", "small"), (99, "http://z.example", big), (107, "http://y.example", "a\r\n\r\nWARC/1.1\r\n" * 80)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(d, path, F.lit("2024-01-01T00:00:00Z"), archive_bytes=4000)
    got = warc.read_captures(spark, path, ranges=4).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, url, h in rows:
        body = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert by[i].url == (None if url is None else re.sub(r"[\r\n]+", " ", url))
    assert [(by[i].record_type, by[i].refers_to) for i in (99, 100, 101, 105)] == [("revisit", 101), ("revisit", 101), ("response", None), ("response", None)]
    ordered = [(r.url_key, r.ts, r.page_id) for r in sorted(got, key=lambda r: (r.range_id, r.position))]
    assert ordered == sorted(ordered)
    empty = str(tmp_path / "none")
    warc.write_archives(d.limit(0), empty, F.lit("2024-01-01T00:00:00Z"))
    assert warc.read_captures(spark, empty).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


# --- language model


def test_language_model_against_brute_force(spark, docs):
    got = lm_score.score_documents(docs, batch_bytes=20_000).collect()
    assert len(got) == docs.count()
    counts, toks = collections.Counter(), {}
    for r in docs.collect():
        t = [*(r.text or "").encode().lower().split(), None]
        toks[r.doc_id, r.text] = t
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((r, len(t), sum(w in counts for w in t)) for (r, _), t in toks.items())
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in got} == set(want)
    base = {(i, len(t)): sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t) for (i, _), t in toks.items()}
    for r in got:
        assert r.train_tokens == n and r.base_score == pytest.approx(base[r.doc_id, r.n_tokens], abs=1e-6) and r.score < 0
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)
    assert lm_score.score_documents(table(spark, [])).count() == 0


def test_mixer_beats_a_fixed_mix_on_repeated_text():
    rng = np.random.default_rng(0)
    h = np.tile(rng.integers(0, 2**63, 50).astype(np.uint64), 40)
    lengths = np.array([len(h)])
    counts = lm_score.count_contexts(h, lengths)
    assert counts.sum() == len(h) * lm_score.BITS * lm_score.ORDERS
    before = lm_score.Mixer(counts).log10(h, lengths).sum()
    learner = lm_score.Mixer(counts, learning=True)
    for _ in range(20):
        _, sums = learner.learn(h, lengths)
    after = lm_score.Mixer(counts, learner.weights, lm_score.refine_map(sums))
    assert after.log10(h, lengths).sum() > before


# --- vectors


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", 150)
    monkeypatch.setattr(vector_dedup, "BLOCK", 200)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = []
    for i in range(900):
        v = base[i % 60] + rng.normal(size=24) * (0.05 if i % 3 else 2.0)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    hot = rng.normal(size=24)
    rows += [(1000 + i, [float(np.float32(x)) for x in hot + rng.normal(size=24) * 0.02], 0) for i in range(400)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(3000, None, 0), (3001, [0.0] * 24, 0), (3002, [float("nan")] * 24, 0), (3003, [None] * 24, 0), (3004, rows[0][1], None), (3005, [1.0], 0), (3006, [2.0], 0), (3007, [], 1), (None, rows[0][1], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(0))
    got = {r.vec_id: r for r in vector_dedup.near_vectors(e).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and i < 3000]
    links, up = collections.Counter(), {i: i for i, *_ in ok}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for lab in (0, 1):
        ids = [i for i, _, x in ok if x == lab]
        x = np.stack([v / np.linalg.norm(v) for _, v, y in ok if y == lab])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
            if a < b:
                links[ids[a]] += 1
                links[ids[b]] += 1
                r, s = find(ids[a]), find(ids[b])
                up[max(r, s)] = min(r, s)
    assert all(got[i].n_links <= links[i] for i in up)
    assert sum(got[i].n_links for i in up) >= 0.95 * sum(links.values())
    assert np.mean([got[i].component_id == find(i) for i in up]) > 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (3000, 3001, 3002, 3003, 3004, 3007))
    assert got[3006].component_id == 3005 and got[3005].n_links == 1 and got[None].component_id is None
    assert vector_dedup.near_vectors(e.limit(0)).count() == 0


def test_vector_links_reach_other_cells(spark, monkeypatch):
    """Pairs just above the threshold in one label of many cells: routing must not lose them."""
    monkeypatch.setattr(vector_dedup, "CELL", 20)
    choose = vector_dedup.choose_pivots
    monkeypatch.setattr(vector_dedup, "choose_pivots", lambda nodes, *_: choose(nodes, 20))
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        u, w = rng.normal(size=(2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        v = 0.935 * u + math.sqrt(1 - 0.935**2) * w / np.linalg.norm(w)
        rows += [(2 * i, u.tolist(), 0), (2 * i + 1, v.tolist(), 0)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) >= 0.97 * len(rows)
    assert sum(not r.kept for r in got) >= 0.97 * 1200


def test_of_two_cells_one_asks_the_other():
    cells = np.arange(40)
    asked = np.stack([vector_dedup.asks(a, cells) for a in cells])
    assert asked.diagonal().all() and (asked ^ asked.T | np.eye(40, dtype=bool)).all()
    assert abs(asked.sum(1) - 20.5).max() <= 1  # no cell asks many more than others


def test_links_of_a_visitor_count_for_both():
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8)[:, :8], 15, axis=0) + rng.normal(size=(120, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    own, copies = list(range(119)), np.ones(119, np.int64)
    graph = vector_dedup.build_graph(x[:119], 1)
    links, back, union, _, _ = vector_dedup.search_block(own, x[:119], copies, graph, np.ones(119, bool), [119], x[119:], 0.93, np.array([3]))
    near = np.flatnonzero(x[:119] @ x[119] >= 0.93)
    assert links.tolist() == [len(near)] and back[near].tolist() == [3] * len(near) and back.sum() == 3 * len(near)
    assert union.find(119) == near.min()


def test_vector_margin_widens_until_links_are_reached(spark, monkeypatch):
    """Two pivots far apart, links between their cells farther away than the least margin."""
    monkeypatch.setattr(vector_dedup, "PROBES", 1)
    monkeypatch.setattr(vector_dedup, "AUDIT_PER_PIVOT", 1000)
    turn = lambda a: np.array([math.cos(a), math.sin(a)])
    p = np.stack([turn(0.0), turn(2.0)])
    rows = [("2:x", i, 1, turn(a).tobytes()) for i, a in enumerate(np.linspace(0.82, 1.18, 40))]
    nodes = spark.createDataFrame(rows, "space string, node long, copies long, unit binary")
    margin = vector_dedup.audited_margins(nodes, {"2:x": p})["2:x"]
    assert margin > vector_dedup.MARGIN
    true = reached = 0
    for _, a, _, u in rows:
        u = np.frombuffer(u)
        cells = vector_dedup.probed_cells(p, u, margin)
        for _, b, _, v in rows:
            if a != b and u @ (v := np.frombuffer(v)) >= vector_dedup.THRESHOLD:
                true += 1
                reached += int(np.argmax(p @ v)) in cells
    assert reached >= 0.99 * true


class Steps:
    """Stands for a DataFrame and its session; keeps the functions that the tasks would run."""

    def __init__(self):
        self.made, self.sparkSession, self.sparkContext = [], self, self

    def broadcast(self, value):
        return types.SimpleNamespace(value=value)

    def select(self, *columns):
        return self

    groupBy = select

    def mapInArrow(self, made, schema):
        self.made.append(made)
        return self

    applyInArrow = mapInArrow


def test_shared_tokens_hold_few_numbers_a_token_at_a_time():
    """What the workers hold for a range beside the 8 bytes of each of its tokens, for it adds to an executor's memory."""
    r, steps = random.Random(3), Steps()
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 300))) for _ in range(2500)]
    texts = [t + " one two three four five six" if i % 5 == 0 else t for i, t in enumerate(texts)] + texts[:200] + ["", None, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)))] * 2 + [pa.array(texts)], ["doc_id", "text_key", "text"])
    hot = np.sort(ngram_join.shingle_sets([b"one two three four five six"])[0])
    ngram_join.shared_tokens(steps, hot, {}, 1)
    pack, meet, gather = steps.made

    def run(made):
        tracemalloc.start()
        out = made()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    packed, most = run(lambda: pa.Table.from_batches(list(pack(iter([batch])))))
    sets = {tuple(s.tolist()) for s in ngram_join.shingle_sets([(t or "").encode() for t in texts]) if len(s)}
    n = sum(map(len, sets))
    assert most < 65 * n
    met, most = run(lambda: meet((pa.scalar(0),), packed))
    assert most < 50 * n
    held, often = collections.Counter(t for s in sets for t in s), set(hot.tolist())
    want = sorted((len(s), sorted(own)) for s in sets if len(own := [np.uint64(t).astype(np.int64).item() for t in s if held[t] > 1 or t in often]) >= ngram_join.needed(len(s)))
    assert sorted((x["n"], sorted(x["tokens"])) for x in gather((pa.scalar(0),), met).to_pylist()) == want
