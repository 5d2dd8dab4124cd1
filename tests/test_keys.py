"""Keys by a name's end against all pairs; names that end alike meet a text once."""

from causaloom.operators import keys


def test_tails_against_all_pairs(spark):
    rows = [(1, 1, "AB12"), (2, 1, "12AB"), (3, 2, "x"), (4, None, "AB"), (5, 1, ""), (6, 1, None), (None, 1, "AB"), (7, 1, "zzz"), (7, 2, "x"), (8, 1, "😀é")]
    names = [(10, 1, "..AB"), (11, 1, "12"), (12, 1, "c12"), (13, 2, "x"), (14, 2, ""), (15, 1, None), (16, None, "AB"), (17, 1, "zz"), (18, 1, "é"), (19, 2, "yx")]
    want = {}
    for i, shared, text in rows:
        for key, theirs, name in names:
            if None not in (i, shared, text, name) and shared == theirs and name[-2:] in text:
                least, n = want.get(i, (key, 0))
                want[i] = (min(least, key), n + 1)
    got = keys.tail_matches(spark.createDataFrame(rows, "id long, shared int, text string"), spark.createDataFrame(names, "key long, shared int, name string"))
    assert {r.id: (r.key, r.n) for r in got.collect()} == want


def test_query_does_not_pair_all_names(spark, tmp_path):
    from causaloom.plans import catalog

    spark.range(3000).selectExpr("id AS c_custkey", "CAST(0 AS int) AS c_nationkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS s_suppkey", "CAST(0 AS int) AS s_nationkey", "concat('Supplier#', lpad(id, 9, '0')) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalog.queries()["fuzzy_key_resolution"](spark, str(tmp_path))
    assert found.count() == 3000 and "BroadcastNestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "_part" in plan
