"""Similar documents pair by pair, with copies in classes."""

import itertools
import random
import re

from causaloom.operators import dedupe


def test_classes_and_pairs_against_all_pairs(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(25)]
    texts = {}
    for k in range(160):
        t = r.choice(base).split()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            t[r.randrange(len(t))] = r.choice(words)
        texts[k] = " ".join(t).upper() if k % 5 == 0 else " ".join(t)
    texts |= {500: "", 501: " \n", 502: None, 503: "one two", 504: "One  TWO"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: grams(t) for k, t in texts.items()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8:
            want[a, b] = round(j, 9)
    got = dedupe.jaccard_pairs(df).collect()
    assert {(x.a, x.b): round(x.jaccard, 9) for x in got} == want and len(got) == len(want) > 100
    members, found = dedupe.jaccard_classes(df)
    reps = {x.doc_id: x.rep for x in members.collect()}
    assert reps == {k: min(i for i, s in sets.items() if s == sets[k]) for k in sets if sets[k]}
    assert {(x.a, x.b) for x in found.collect()} == {p for p in want if reps[p[0]] == p[0] and reps[p[1]] == p[1] and sets[p[0]] != sets[p[1]]}


def test_many_copies_are_one_class(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'a b c d e f g' AS text")
    members, found = dedupe.jaccard_classes(df)
    assert members.filter("rep = 0").count() == 20_000 and found.count() == 0


def test_signatures_are_the_least_hashes_and_are_not_exploded(spark):
    from pyspark.sql import functions as F

    rows = [(1, [5, -7, 2**62]), (2, [0]), (3, list(range(-400, 700))), (1, [-9]), (None, [4])]
    sets = spark.createDataFrame(rows, "doc_id long, set array<long>")
    got = dedupe.signatures(sets, 9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    want = sets.select("doc_id", F.explode("set").alias("token")).groupBy("doc_id").agg(F.array(*[F.min(F.xxhash64(F.lit(p), "token")) for p in range(9)]).alias("sig"))
    assert {(r.doc_id, tuple(r.sig)) for r in got.collect()} == {(r.doc_id, tuple(r.sig)) for r in want.collect()}
    assert dedupe.signatures(sets.limit(0), 9).count() == 0


def test_shingle_hashes_are_those_of_the_words():
    r = random.Random(4)
    texts = ["", " \x0b\n", "a", "a b", "b a", "a b c d e", "ab c d e f", "a\tb\x0cc d\re f", "x" * 5000 + " y", "é ü 漢字   z", *[" ".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(300)]]

    def grams(t):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want, got = [grams(t) for t in texts], dedupe.shingle_sets([t.encode() for t in texts])
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all((x[1:] > x[:-1]).all() for x in got)
    for i, j in itertools.combinations(range(0, len(texts), 3), 2):
        assert len(want[i] & want[j]) == len(set(got[i].tolist()) & set(got[j].tolist()))


def test_only_prefixes_are_shuffled_and_frequent_shingles_come_last(spark):
    import numpy as np

    line = " ".join(f"common{i}" for i in range(12))
    rows = [(k, " ".join(f"{k}w{i}" for i in range(40)) + " " + line) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, least = 48, 10  # 48 shingles, a prefix has 48 - ceil(0.8 * 48) + 1
    first = dedupe._prefix_rows(df, 0.8, np.zeros(0, np.int64)).collect()
    assert len(first) == 60 * least and {r.place >> 32 for r in first} == {n}
    common = np.array(dedupe.shingle_sets([line.encode()])[0])
    last = dedupe._prefix_rows(df, 0.8, common).collect()
    assert len(last) == 60 * least and not {r.token for r in last} & set(common.tolist())
    members, found = dedupe.jaccard_classes(df)
    assert members.count() == 60 and found.count() == 0


def _near_copies(n: int, words: int, changed: int, seed: int) -> dict[int, str]:
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for k in range(n):
        t = list(base)
        for at in r.sample(range(words), changed):
            t[at] = f"x{k}y{at}"
        out[k] = " ".join(t)
    return out


def _similar(texts: dict[int, str]) -> dict[tuple[int, int], float]:
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in texts.items() if (w := t.lower().split())}
    return {(a, b): j for a, b in itertools.combinations(sorted(sets), 2) if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8}


def test_sets_of_a_group_are_not_sent_once_a_pair(spark):
    texts = _near_copies(200, 600, 6, 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        all_stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x := all_stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(all_stages.size())}

    before = set(stages())
    want = _similar(texts)
    from causaloom.operators.shared import settings

    with settings(spark, {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = {(x.a, x.b): x.jaccard for x in dedupe.jaccard_classes(df)[1].collect()}
    assert found == want and len(want) > 15_000
    size = 200 * 600 * 8
    assert sum(b for k, b in stages().items() if k not in before) < 5 * size  # a set for each pair would be 90 times the sets


def test_small_blocks_and_chunks_give_the_same_pairs(spark, monkeypatch):
    for name, value in {"BLOCK_SETS": 7, "PARTS_OF_SETS": 5, "LOOKED_AT": 50, "PACKED": 40, "OFTEN": 3, "FREQUENT": 30}.items():
        monkeypatch.setattr(dedupe, name, value)
    texts = _near_copies(40, 100, 1, 6) | {100 + k: t for k, t in _near_copies(30, 12, 1, 7).items()} | {200: "a", 201: "A ", 202: "a b"}
    r = random.Random(8)
    texts |= {300 + k: " ".join(r.choice("abc") for _ in range(r.randint(1, 200))) for k in range(60)}
    texts |= {1000 + k: t for k, t in texts.items() if k % 3 == 0}  # copies
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    got = [(x.a, x.b, round(x.jaccard, 9)) for x in dedupe.jaccard_pairs(df).collect()]
    want = _similar(texts)
    assert len(got) == len(want) > 200 and {(a, b): j for a, b, j in got} == {p: round(j, 9) for p, j in want.items()}
    assert spark.conf.get(name) == held


def test_a_pair_is_told_where_it_meets_first_and_seldom_again(spark):
    import numpy as np

    texts = _near_copies(60, 500, 5, 9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    alone, among = dedupe._among(df, df.select("doc_id"), 60)
    every = np.full(1 << 14, -1)  # all tokens pass
    rows = dedupe._meetings(dedupe._shared_rows(alone, 0.8, np.zeros(0, np.int64), among, every), 0.8).collect()
    first = {}
    for x in rows:
        first[x.ka, x.kb] = min(first.get((x.ka, x.kb), (1 << 62)), x.places)
    prefixes = {}
    for x in dedupe._prefix_rows(df, 0.8, np.zeros(0, np.int64)).collect():
        prefixes.setdefault(x.key, {})[x.token] = x.place & 0xFFFFFFFF
    want, met = {}, 0
    for a, b in itertools.combinations(sorted(prefixes), 2):
        if common := prefixes[a].keys() & prefixes[b].keys():
            met += len(common)
            want[a, b] = min(prefixes[a][t] << 32 | prefixes[b][t] for t in common)
    assert first == want
    assert 5 * len(rows) < met
