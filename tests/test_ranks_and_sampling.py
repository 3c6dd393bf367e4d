import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import ranks, reports, sampling


@pytest.mark.parametrize("rows_per_range", [10**6, 100])
def test_quantiles_with_ties(spark, rows_per_range):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=1500), "b": np.repeat(7.0, 900), "c": np.array([2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.33, 0.5, 0.66, 1.0]
    found = {r["g"]: r["quantiles"] for r in ranks.exact_quantiles(df, "v", shares, "g", rows_per_range).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert found[g] == pytest.approx(list(np.percentile(vs, [100 * s for s in shares])))


def test_order_statistics_counts(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 2, 5] * 100], "v long")
    asked = F.array(*[F.lit(r).cast("long") for r in (0, 250, 499)]).alias("ranks")
    found = ranks.ranked_values(df, "v", lambda sizes: sizes.select("g", asked), rows_per_range=50).collect()
    assert sorted((f.rank, f.value, f.below, f.equal) for f in found) == [(0, 1, 0, 100), (250, 2, 100, 300), (499, 5, 400, 100)]


def test_expand_copies(spark, monkeypatch):
    monkeypatch.setattr(ranks, "COPIES_PER_TASK_ROW", 10)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 37)], "k string, n long")
    found = ranks.expand_copies(df, "n", "i").groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("i"))
    assert {r["k"]: r["i"] for r in found.collect()} == {k: list(range(1, n + 1)) for k, n in (("b", 1), ("c", 10), ("d", 37))}


def test_split_sizes_and_partition(spark):
    df = spark.range(2848).select("id", F.when(F.col("id") % 579 == 0, 1).otherwise(0).alias("Class"))
    train, test = sampling.stratified_split(df)
    assert test.count() == 570 and test.filter("Class = 1").count() == 1
    assert train.count() + test.count() == 2848
    assert train.join(test, "id").count() == 0
    again = sampling.stratified_split(df.repartition(9))[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in test.collect()}


def test_split_sizes_of_the_card_table(spark):
    sizes = spark.createDataFrame([(0, 284_315), (1, 492)], "cls int, n long")
    found = sampling.share_out(sizes, "cls", 0.2).collect()
    assert {r["cls"]: r["take"] for r in found} == {0: 56_864, 1: 98}


def test_split_cuts_through_copies(spark):
    rows = [(1, 0)] * 700 + [(i, 0) for i in range(2, 302)] + [(5, 1)] * 50
    df = spark.createDataFrame(rows, "x long, Class int").repartition(4)
    train, test = sampling.stratified_split(df)
    assert test.groupBy("Class").count().orderBy("Class").collect() == [(0, 200), (1, 10)]
    assert sorted(map(tuple, train.unionByName(test).collect())) == sorted(rows)


def test_sample_rows(spark):
    df = spark.range(5000).toDF("id")
    assert sampling.sample_rows(df, 0).count() == 0
    assert sampling.sample_rows(df, 9000).count() == 5000
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()[:15])
    for n in (1, 700):
        assert {r["id"] for r in sampling.sample_rows(df, n).collect()} == set(order[:n])
    copies = spark.createDataFrame([(i // 40,) for i in range(1000)], "id long")
    assert sampling.sample_rows(copies, 130).groupBy("id").count().orderBy("count").collect()[0]["count"] == 10


def test_lowest_per_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.randrange(10**6)) for i in range(3000)]
    found = sampling.lowest_per_group(spark.createDataFrame(rows, "g string, h long"), ["g"], "h", 7).collect()
    for g in {r[0] for r in rows}:
        assert sorted(r["h"] for r in found if r["g"] == g) == sorted(h for k, h in rows if k == g)[:7]


def banded(spark, rows, m, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, fraud_probability double, Amount double")
    return sampling.banded_sample(df, m, 0.1, 0.9, **kw).collect()


def test_banded_sample_has_all_bands(spark):
    rng = random.Random(40)
    rows = [(rng.random(), 0.0) for _ in range(60)]
    found = banded(spark, rows, 8, amount=None)
    ps = [r["fraud_probability"] for r in found]
    assert len(ps) == 8 and ps == sorted(ps, reverse=True) and min(ps) >= 0.1
    assert {(p >= 0.9) + (p >= 0.5) for p in ps} == {0, 1, 2}


def test_banded_sample_spreads_amounts(spark):
    """Every band gives its quota, and every band's low, middle and high amounts are met."""
    rng = random.Random(41)
    rows = [(rng.uniform(low, high), rng.choice([0.5, rng.uniform(2, 900)])) for low, high in ((0.1, 0.49), (0.5, 0.89), (0.9, 1.0)) for _ in range(200)]
    found = banded(spark, rows, 30)
    bands = [sum(low <= r["fraud_probability"] < high for r in found) for low, high in ((0.1, 0.5), (0.5, 0.9), (0.9, 1.1))]
    assert sum(bands) == 30 and all(n >= 9 for n in bands)
    for low, high in ((0.1, 0.5), (0.5, 0.9), (0.9, 1.1)):
        large = np.quantile([a for p, a in rows if low <= p < high and a > 1], [0.33, 0.66])
        places = np.searchsorted(large, [r["Amount"] for r in found if low <= r["fraud_probability"] < high])
        assert set(places.tolist()) == {0, 1, 2}


def test_amount_pools_of_many_groups(spark):
    """No group loses its pools, however many there are."""
    rows = [(g, float(v)) for g in range(2_000) for v in (2, 5, 9)]
    found = sampling.amount_pools(spark.createDataFrame(rows, "band int, _amount double")).groupBy("pool").count().collect()
    assert {r["pool"]: r["count"] for r in found} == {0: 2_000, 1: 2_000, 2: 2_000}


def test_banded_quotas_fill_and_top_up(spark):
    assert sampling.band_quotas(50) == [18, 15, 18]
    rng = random.Random(2)
    rows = [(rng.uniform(0.1, 0.5), rng.uniform(0, 50)) for _ in range(3000)] + [(0.95, 5.0)] * 4
    found = banded(spark, rows, 50)
    assert len(found) == 50
    assert sum(r["fraud_probability"] >= 0.9 for r in found) == 4
    assert all(r["Amount"] > 1 for r in found)
    assert [r["position"] for r in found] == list(range(1, 51))
    assert banded(spark, rows, 50) == found
    assert banded(spark, [(0.05, 1.0)], 5) == [] and banded(spark, rows, 0) == []


def test_amount_pools(spark):
    rows = [(1, v) for v in (0.5, 2.0, 3.0, 4.0, 5.0)] + [(2, 0.2), (2, 9.0)] + [(3, 4.0)] * 6
    found = sampling.amount_pools(spark.createDataFrame(rows, "band int, _amount double")).collect()
    by_row = {(r["band"], r["_amount"]): r["pool"] for r in found}
    assert by_row == {(1, 0.5): None, (1, 2.0): 0, (1, 3.0): 1, (1, 4.0): 2, (1, 5.0): 2, (2, 0.2): 0, (2, 9.0): 0, (3, 4.0): 0}


def plain_quotas(rows, quotas, total):
    """The quota rules, taken row by row from (band, pool, large, saved) in turn; returns row numbers."""
    taken = set()

    def take(allowed, places):
        for i, r in enumerate(rows):
            if places <= 0:
                return
            if i not in taken and allowed(r):
                taken.add(i)
                places -= 1

    for band, quota in enumerate(quotas, start=1):
        left = min(quota, total - len(taken))
        share = max(1, left // 3)
        for pool in range(3):
            before = len(taken)
            take(lambda r: r[0] == band and r[1] == pool, min(share, left))
            left -= len(taken) - before
        any_large = any(r[0] == band and r[2] for i, r in enumerate(rows) if i not in taken)
        take(lambda r: r[0] == band and (r[2] or not any_large), left)
    if any(r[2] and r[3] for r in rows):
        take(lambda r: r[2] and r[3], total - len(taken))
    take(lambda r: r[3], total - len(taken))
    return taken


@pytest.mark.parametrize("total", [1, 2, 3, 5, 9, 20, 50])
def test_quota_rules_equal_a_plain_version(spark, total):
    rng = random.Random(total)
    tables, rows = [], []
    for number in range(6):
        weights = [rng.random() for _ in range(3)]
        own = [
            (rng.choices([1, 2, 3], weights)[0], rng.choice([None, 0, 1, 2]), rng.random() < rng.choice([0.0, 0.1, 0.8]), rng.random() < 0.7)
            for _ in range(rng.choice([0, 3, 12, 80]))
        ]
        tables.append(own)
        rows += [(number, i, 0.5, 1.0, *r) for i, r in enumerate(own)]
    df = spark.createDataFrame(rows, "_all int, _hash long, _p double, _amount double, band int, pool int, _large boolean, _saved boolean")
    got = sampling.fill_quotas(df, sampling.band_quotas(total), total).select("_all", "_hash").collect()
    for number, own in enumerate(tables):
        assert {r["_hash"] for r in got if r["_all"] == number} == plain_quotas(own, sampling.band_quotas(total), total)


def test_parts_are_searched_in_nodes_of_few_cuts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FANOUT", 4)
    ids = [f"k{i:03d}" for i in range(0, 300, 3)]
    cuts = spark.createDataFrame([(1.0, c) for c in ids + ids[:9]] + [(2.0, "k100")], "m double, cut string")
    values = [None, "a", "z", *[f"k{i:03d}" for i in range(300)]]
    rows = spark.createDataFrame([(m, v) for m in (1.0, 2.0, 3.0, None) for v in values], "m double, v string")
    found = ranks.with_part(rows, cuts, "m", "v", len(ids), "part")
    held = {1.0: ids, 2.0: ["k100"]}
    assert found.columns == ["m", "v", "part"] and found.count() == rows.count()
    assert all(r["part"] == sum(c <= r["v"] for c in held.get(r["m"], []) if r["v"]) for r in found.collect())


def test_cumulative_amount_of_one_moment_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FANOUT", 4)
    lines = [(f"t{i % 900:04d}", 1.0 + i % 7, "2024-01-01T00:00:00Z" if i % 10 else f"2024-01-{2 + i % 20:02d}T00:00:00Z") for i in range(3000)]
    df = spark.createDataFrame(lines, "transaction_id string, Amount double, event_time_utc string")
    searched = []
    monkeypatch.setattr(ranks, "with_part", lambda *args, own=ranks.with_part: searched.append(args[4]) or own(*args))
    got = reports.cumulative_amount(df, rows_per_range=30).collect()
    assert searched and searched[0] > 50
    got.sort(key=lambda r: (r["_event_time"], r["transaction_id"], r["cum_amount"]))
    total, want = 0.0, {}
    for time, name, amount in sorted((t, n, a) for n, a, t in lines):
        total += amount
        want[time, name] = total
    assert [r["cum_amount"] for r in got] == sorted(r["cum_amount"] for r in got) and len(got) == 3000
    last = {(r["_event_time"].strftime("%Y-%m-%dT%H:%M:%SZ"), r["transaction_id"]): r["cum_amount"] for r in got}
    assert last == want
