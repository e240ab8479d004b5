"""Segment operators on small cases."""

from vocalis.operators.segments import merge_short, transfer_labels


def test_transfer_labels_cases(spark):
    labels = spark.createDataFrame([("u", 1, 0.0, 5.0, "a"), ("u", 2, 1.0, 3.0, "b"), ("u", 3, 6.0, 8.0, "c")], "k string, t int, start double, end double, label string")
    rows = [("u", 1, 1.0, 2.0), ("u", 2, 5.0, 5.0), ("u", 3, 5.0, 7.0), ("u", 4, 6.5, 6.5), ("u", 5, 9.0, 10.0), ("v", 6, 0.0, 1.0)]
    segments = spark.createDataFrame(rows, "k string, t int, start double, end double")
    got = {r["t"]: r["new_label"] for r in transfer_labels(segments, labels, ["k"], "t", "t").collect()}
    # an end equal to a start is not behind it; without duration only a segment that lies inside gets a label
    assert got == {1: "a", 2: "OUTSIDE", 3: "OUTSIDE", 4: "c", 5: "OUTSIDE", 6: "OUTSIDE"}


def test_merge_short_equals_a_fold_however_large_the_key(spark):
    import random

    rng, rows = random.Random(2), []
    for key, n in (("a", 60_000), ("b", 1), ("c", 40), (None, 7), ("d", 2)):
        at = 0.0
        for i in range(n):
            rows.append((key, i, at, at + rng.random()))
            at += 1 + rng.random()
    want = []
    for key in {r[0] for r in rows}:
        done, left = [], None
        for _, _, start, end in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            left = (left[0] if left else start, end)
            if left[1] - left[0] > 1.5:
                done.append(left)
                left = None
        if left and done and left[1] - left[0] < 1.5:
            done[-1] = (done[-1][0], left[1])
        elif left:
            done.append(left)
        want += [(key, *s) for s in done]
    shuffled = rng.sample(rows, len(rows))
    df = merge_short(spark.createDataFrame(shuffled, "k string, t int, start double, end double"), ["k"], "t")
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def _events(folder, spark):
    """Events whose values make whole, short, empty and (for a reference that begins a quarter of a second later) backward segments."""
    values = [(1, 0, 30.0), (1, 5, 0.1), (1, 6, 0.0), (1, 20, 0.25), (2, 0, 0.0), (2, 1, 2.5), (2, 2, 0.2), (3, 4, 0.1)]
    rows = [(i, user, at, "ab"[i % 2], value) for i, (user, at, value) in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at int, event_type string, value double")
    df.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, at) as ts", "user_id", "event_type", "value", "'{}' as props").write.parquet(f"{folder}/events.parquet")


def _against_sql(spark, folder, name):
    import duckdb

    from vocalis.plans import registry

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(folder))
    got = df.select(*(c[0] for c in cur.description)).collect()
    return sorted(tuple(r) for r in got), sorted(cur.fetchall())


def test_overlaps_of_empty_and_backward_segments_equal_their_sql(spark, tmp_path):
    _events(tmp_path, spark)
    got, want = _against_sql(spark, tmp_path, "der_overlap")
    assert got == want and any(r[-1] < 0 for r in want)
    got, want = _against_sql(spark, tmp_path, "der_rates")
    assert got == want


def test_rttm_keeps_segments_without_duration(spark, tmp_path):
    _events(tmp_path, spark)
    got, want = _against_sql(spark, tmp_path, "rttm_roundtrip")
    assert got == want and len(got) == 8
