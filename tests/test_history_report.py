from pyspark.sql import functions as F

from boardwalk.operators import history as H
from boardwalk.operators import report as R
from boardwalk.operators import skew
from boardwalk.sources import tables as S
from helpers import shredded

MATCHES = "board_id long, page_no int, seq long, company string, title string, url string, matched_keywords array<string>"


def matches(spark, *rows):
    return spark.createDataFrame(list(rows), MATCHES)


RUN = [
    (1, 1, 2, "Beta", "t1", "u1", ["qa"]), (1, 1, 1, "Beta", "t2", "u2", ["api", "qa"]),
    (2, 1, 1, "Alpha", "t3", "u3", ["go"]), (3, 1, 1, "alpha", "t4", "u1", ["go"]),
]


def urls(df):
    return sorted(r["url"] for r in df.collect())


def test_split_is_whole_and_disjoint(spark):
    rows = matches(spark, *RUN)
    for known in ([], ["u1"], ["u1", "u2", "u3"], ["zz", "u3", "u3"]):
        history = spark.createDataFrame([(u,) for u in known], "url string")
        for small in (True, False):
            new, seen = H.new_matches(rows, history, small=small), H.seen_matches(rows, history, small=small)
            assert urls(seen) == sorted(r[5] for r in RUN if r[5] in known)
            assert sorted(urls(new) + urls(seen)) == sorted(r[5] for r in RUN)
            both = H.with_section(rows, history, small=small)
            assert urls(both.filter("section = 'seen'")) == urls(seen) and both.count() == len(RUN)


def test_report_tables(spark):
    rows = H.with_section(matches(spark, *RUN), spark.createDataFrame([("u1",)], "url string"))
    groups = [tuple(r) for r in R.report_groups(rows).collect()]
    assert groups == [("new", "Alpha", 1), ("new", "Beta", 1), ("seen", "Beta", 1), ("seen", "alpha", 1)]
    assert tuple(R.report_totals(rows).first()) == (4, 2, 2, 3)
    flat = [(r["section"], r["title"], r["keywords"]) for r in R.report_rows(rows).collect()]
    assert flat == [("new", "t3", "go"), ("new", "t2", "api, qa"), ("seen", "t1", "qa"), ("seen", "t4", "go")]
    assert [r["n_jobs"] for r in R.report_groups(rows, by_section=False).collect()] == [1, 2, 1]


def test_history_from_report(spark):
    html = (
        '<a class="job-link" href="u1">a</a><td><a target="_blank" class="x job-link" href="u2">b</a></td>'
        '<a class="job-link" href="u1">again</a><a class="job-link">no href</a>'
        '<a class="job-links" href="u3">c</a><b class="job-link" href="u4"></b><a class="job-link" href="">e</a>'
    )
    assert urls(H.history_from_report(shredded(spark, html))) == ["u1", "u2"]
    assert urls(H.history_from_report(shredded(spark, "<p>nothing</p>"))) == []


def test_two_runs_and_an_empty_one(spark, tmp_path):
    root = str(tmp_path / "store")
    assert S.read_history(spark, root).count() == 0
    first, second = matches(spark, *RUN[:2]), matches(spark, *RUN[1:])
    S.write_matches(H.with_section(first, S.read_history(spark, root)), root, 1)
    assert urls(S.read_history(spark, root)) == ["u1", "u2"]
    rows = H.with_section(second, S.read_history(spark, root))
    S.write_matches(rows, root, 2)
    assert urls(S.read_history(spark, root)) == ["u1", "u2", "u3"]
    assert urls(S.read_history(spark, root, before=2)) == ["u1", "u2"]
    S.write_matches(second.limit(0), root, 3)
    assert S.read_history(spark, root).count() == 0  # last run only


def hot_facts(spark, n=6000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").cast("string").alias("v"),
    )


def test_salted_lookup_equals_plain_join(spark):
    facts = hot_facts(spark)
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    for how in ("inner", "left"):
        plain = sorted(map(tuple, facts.join(dim, "k", how).select("id", "k", "d").collect()), key=str)
        for small in (True, False, None):
            got = skew.lookup_join(facts, dim, ["k"], how, spread_by=["id"], small=small)
            assert sorted(map(tuple, got.select("id", "k", "d").collect()), key=str) == plain


def test_history_with_a_hot_url(spark):
    facts = hot_facts(spark).select("id", F.concat(F.lit("u"), F.col("k").cast("string")).alias("url"))
    history = spark.range(30).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    for small in (True, False, None):
        new, seen = H.new_matches(facts, history, small=small), H.seen_matches(facts, history, small=small)
        assert seen.count() == facts.filter("cast(substr(url, 2) AS int) < 30").count()
        assert new.count() + seen.count() == facts.count() == H.with_section(facts, history, small=small).count()
    assert not skew.fits_broadcast(facts, max_rows=10) and skew.fits_broadcast(history)
    assert not skew.fits_broadcast(history, max_bytes=100)


def test_a_history_in_buckets_is_not_moved(spark, tmp_path):
    root = str(tmp_path / "it's a store")
    first = spark.createDataFrame([(1, f"u{k % 40}") for k in range(60)], "board_id long, url string")
    S.write_matches(first, root, 1, buckets=6)
    history = S.read_history(spark, root)
    assert urls(history) == sorted({f"u{k}" for k in range(40)}) and urls(S.read_history(spark, root)) == urls(history)
    later = spark.createDataFrame([(2, f"u{k}") for k in range(30, 50)] + [(3, None)], "board_id long, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = H.with_section(later, history)
        assert {(r["url"], r["section"]) for r in rows.collect()} == {
            (None if k is None else f"u{k}", "seen" if k is not None and k < 40 else "new") for k in [*range(30, 50), None]}
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(plan) if "Scan parquet" in line and "Bucketed: true" in line)
    depth = plan[at].index("FileScan")
    above = []
    for line in reversed(plan[:at]):
        here = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if here < depth:
            depth = here
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)
    S.write_matches(later, root, 2)  # a run without buckets is read as before
    assert urls(S.read_history(spark, root).filter("url IS NOT NULL")) == [f"u{k}" for k in range(30, 50)]
    assert urls(S.read_history(spark, root, before=2)) == urls(history)


def test_heavy_keys_get_salts_by_their_share(spark):
    facts = spark.range(40_000).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 8 == 1, F.lit(8)).otherwise(F.col("id") % 5000 + 100).alias("k"))
    found = {r["_key"]: r["_salts"] for r in skew.heavy_keys(facts, ["k"], 16).collect()}
    hashes = {r["k"]: r["h"] for r in spark.createDataFrame([(7,), (8,)], "k long").select("k", F.xxhash64("k").alias("h")).collect()}
    assert set(found) == set(hashes.values())
    assert 12 <= found[hashes[7]] <= 20 and 2 <= found[hashes[8]] <= 6
    assert skew.heavy_keys(facts.filter("k >= 100"), ["k"], 16) is None and skew.heavy_keys(facts.limit(0), ["k"], 16) is None


def test_the_rows_of_a_heavy_key_are_spread(spark):
    facts = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 3000).alias("k"))
    facts = facts.withColumns({"_key": F.lit("mine"), "_salts": F.lit("too")})
    lookup = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = skew.lookup_join(facts, lookup, ["k"], "left", spread_by=["id"], small=False)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert joined.filter("v = 'x' AND _key = 'mine' AND _salts = 'too'").count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
