"""Building blocks against brute force, with one hot group and under other partitionings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmine import core as K
from prefmine.operators import dedup as D
from prefmine.operators import graph as H
from prefmine.operators import joins as J
from prefmine.operators import sampling as G


@pytest.fixture(scope="module")
def skewed(spark):
    """2 000 rows; group 'hot' holds a third of them, one user and one item as well."""
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"g{rng.randrange(20)}", 0 if hot else rng.randrange(1, 60), rng.randrange(0, 40), rng.randrange(0, 500), 1 + i % 5))
    return spark.createDataFrame(rows, "id bigint, grp string, user bigint, item bigint, v int, rating int")


def test_bucketed_rank(skewed):
    got = K.bucketed_rank(skewed, ["grp"], F.floor(F.col("v") / 50), [F.col("v"), F.col("id")], "r").select("grp", "v", "id", "r").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["grp"], []).append((r["v"], r["id"], r["r"]))
    assert sum(map(len, by_group.values())) == 2000
    for rows in by_group.values():
        assert [r for *_, r in sorted(rows)] == list(range(1, len(rows) + 1))


def test_bucketed_sum(skewed):
    got = K.bucketed_sum(skewed, ["grp"], F.floor(F.col("v") / 50), [F.col("v"), F.col("id")], F.col("v"), "s").select("grp", "v", "id", "s").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["grp"], []).append((r["v"], r["id"], r["s"]))
    for rows in by_group.values():
        total = 0
        for v, _, s in sorted(rows):
            total += v
            assert s == total


@pytest.mark.parametrize("parts", [1, 7])
def test_global_position(skewed, parts):
    got = K.global_position(skewed.repartition(parts), [F.col("v"), F.col("id")]).select("v", "id", "position").collect()
    assert [r["position"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == list(range(1, 2001))


def test_exact_quantiles(skewed):
    df = skewed.select((F.col("v") * 1.37 + F.col("id") / 7.0).alias("x"))
    got = K.exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    want = np.quantile([r["x"] for r in df.collect()], [0.1, 0.5, 0.99])
    assert np.allclose([got["a"], got["b"], got["c"]], want)


def test_explode_range(spark):
    df = spark.createDataFrame([("a", 25_003), ("b", 0), ("c", 2)], "k string, n bigint")
    got = K.explode_range(df, F.col("n"), "i", 1000).groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.countDistinct("i").alias("u")).collect()
    assert {tuple(r) for r in got} == {("a", 25_003, 1, 25_003, 25_003), ("c", 2, 1, 2, 2)}


def test_hash_uniform_is_uniform_and_stable(spark):
    a = spark.range(20_000).repartition(3).select("id", K.hash_uniform(1, "id").alias("u"))
    b = {r["id"]: r["u"] for r in spark.range(20_000).repartition(9).select("id", K.hash_uniform(1, "id").alias("u")).collect()}
    rows = a.collect()
    assert all(b[r["id"]] == r["u"] for r in rows)
    assert abs(np.mean([r["u"] for r in rows]) - 0.5) < 0.01 and abs(np.std([r["u"] for r in rows]) - math.sqrt(1 / 12)) < 0.01


def test_item_pairs_chunked(skewed):
    cells = skewed.groupBy("user", "item").agg(F.sum("rating").cast("double").alias("x"))
    rows = cells.collect()
    by_user = {}
    for r in rows:
        by_user.setdefault(r["user"], []).append((r["item"], r["x"]))
    want = {}
    for items in by_user.values():
        for i, x in items:
            for j, y in items:
                if i < j:
                    n, s = want.get((i, j), (0, 0.0))
                    want[i, j] = (n + 1, s + x * y)
    for chunk in (3, 1000):
        got = {(r["item_a"], r["item_b"]): (r["common"], r["dot"]) for r in J.item_pairs(cells, "user", "item", {"dot": ("x", "x")}, chunk).collect()}
        assert got == want


def test_previous_in_order(skewed):
    got = D.previous_in_order(skewed.select("grp", "v", "id"), ["grp"], F.floor(F.col("v") / 7), ["v", "id"], {"before": "id"}).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["grp"], []).append((r["v"], r["id"], r["before"]))
    for rows in by_group.values():
        rows.sort()
        assert [b for *_, b in rows] == [None, *[i for _, i, _ in rows[:-1]]]


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    sigs = []
    for i in range(900):
        s = 7 if i % 3 == 0 else rng.choice(base) ^ (1 << rng.randrange(4) if rng.random() < 0.5 else 0)
        sigs.append((i, "hot" if i % 2 else f"c{i % 5}", 0 if i % 50 == 1 else s))
    signed = [(i, c, s - (1 << 64) if s >= 1 << 63 else s) for i, c, s in sigs]
    df = spark.createDataFrame(signed, "id bigint, cat string, signature bigint")
    for strict in (False, True):
        want = set()
        for cat in {c for _, c, _ in sigs}:
            rows = sorted((s, i) for i, c, s in sigs if c == cat and (strict or s != 0))
            want |= {b[1] for a, b in zip(rows, rows[1:]) if bin(a[0] ^ b[0]).count("1") <= 3}
        got = [r["id"] for r in D.near_duplicates(df, "cat", "id", strict=strict).collect()]
        assert set(got) == want and len(got) == len(want)


def test_grouped_quantiles(spark):
    """Many distinct values in one hot group, ties, wide ranges, null keys and values, single rows."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [("hot", float(x)) for x in np.concatenate([rng.normal(size=3000), rng.exponential(1e9, 500), [-1e308, 1e308]])]
    rows += [("ties", float(i % 3)) for i in range(100)] + [("one", 4.5), (None, 1.0), (None, 2.0), ("gap", None), ("gap", 7.0), ("nan", float("nan"))]
    rows += [(f"g{i % 40}", float(rng.random())) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.993, "e": 1.0}
    got = {r["k"]: tuple(r)[1:] for r in K.grouped_quantiles(df, ["k"], "x", probs, 16).collect()}
    groups = {}
    for k, x in rows:
        if x is not None and x == x:
            groups.setdefault(k, []).append(x)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert np.allclose(got[k], np.quantile(values, list(probs.values())), rtol=1e-12), k
    whole = K.grouped_quantiles(df.filter("k LIKE 'g%'"), [], "x", {"m": 0.5}).scalar
    assert spark.range(1).select(whole().alias("m")).first()["m"] == pytest.approx(np.median([x for k, x in rows if k and k[0] == "g" and x is not None]))
    assert K.grouped_quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).count() == 0


def test_band_classes_brute_force(spark):
    """All pairs within three bits, also where one band's value is shared by most signatures."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    sigs = {}
    for i in range(700):
        s = rng.choice(base)
        for _ in range(rng.randrange(5)):
            s ^= 1 << rng.randrange(64)
        sigs[i] = s if i % 3 else (s & ~0xFFFF0000) | 0xBEEF0000 if i % 60 else 0
    near = {i: {j for j in sigs if j != i and bin(sigs[i] ^ sigs[j]).count("1") <= 3} for i in sigs}
    df = spark.createDataFrame([(i, s - (1 << 64) if s >= 1 << 63 else s) for i, s in sigs.items()], "id bigint, signature bigint").repartition(4)
    for strict, sizes in ((False, {}), (True, {"cell": 16, "shard": 100})):
        some = {i for i in sigs if strict or sigs[i]}
        label = {i: i for i in some}
        for _ in some:
            label = {i: min([label[i], *(label[j] for j in near[i] & some)]) for i in some}
        got = {r["id"]: (r["class_id"], r["n_links"]) for r in D.band_classes(df, "id", strict=strict, **sizes).collect()}
        assert got == {i: (label[i], len(near[i] & some)) for i in some}
    assert D.band_classes(df.limit(0), "id").count() == 0


def test_simhash_by_hand(spark):
    from hashlib import md5

    def signature(text):
        text = " ".join(text.lower().split())
        if len(text) < 20:
            return 0
        votes = [0] * 64
        for w in text.split():
            digest = md5(w.encode()).digest()[:8]
            for b in range(64):
                votes[b] += 1 if digest[b // 8] >> (b % 8) & 1 else -1
        value = sum(1 << b for b in range(64) if votes[b] > 0)
        return value - (1 << 64) if value >= 1 << 63 else value

    texts = ["Short text", "The quick  brown fox jumps\nover the lazy dog", "word " * 5000, "", "Größe und Maß für alle Fälle im Leben"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {r["id"]: r["signature"] for r in D.simhash(df, "id", F.col("t")).collect()}
    assert got == {i: signature(t) for i, t in enumerate(texts)}


def test_k_core_fixpoint(skewed):
    rows = [(r["user"], r["item"], r["id"]) for r in skewed.collect()]
    while True:
        users, items = {}, {}
        for u, i, _ in rows:
            users[u] = users.get(u, 0) + 1
            items[i] = items.get(i, 0) + 1
        kept = [r for r in rows if users[r[0]] >= 16 and items[r[1]] >= 40]
        if len(kept) == len(rows):
            break
        rows = kept
    got = {r["id"] for r in H.k_core(skewed, "user", "item", 16, 40).collect()}
    assert got == {i for *_, i in rows} and 0 < len(got) < 2000


@pytest.mark.parametrize("share", [0.0, 0.333, 0.8, 1.0])
def test_temporal_split_with_a_hot_day(spark, share):
    rows = [(f"2020-01-{1 + (0 if i % 3 == 0 else i % 20):02d} 00:00:00", i * 7 % 500, i) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, user bigint, id bigint").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["id"]: r["split"] for r in H.temporal_split(df, share, ["ts", "user", "id"]).collect()}
    order = [i for _, _, i in sorted(rows)]
    cut = math.floor(share * 500)
    assert got == {i: "train" if n < cut else "test" for n, i in enumerate(order)}


def test_resampling_keeps_sizes_and_ignores_partitions(skewed):
    rows = skewed.withColumn("copy_id", F.lit("0"))
    a, b = [{tuple(r) for r in G.popularity_inverse(rows.repartition(n), "grp", "item", ["id"]).select("id", "copy_id").collect()} for n in (2, 9)]
    assert a == b and len(a) == 2000
    before = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}
    grown = G.oversample(rows, "grp", ["id"], F.lit(2000)).groupBy("grp").count().collect()
    for r in grown:
        n = before[r["grp"]]
        assert r["count"] == max(n, int(n * (1 + 5 * (1 / math.log1p(n)) / math.log1p(2000))))


def test_oversample_target_known_size(spark):
    row = spark.range(1).select(G.oversample_target(F.lit(3_423_672), F.lit(4_398_666)).alias("n")).first()
    assert row["n"] == 3_498_048


def test_negatives_are_complete_and_unseen(spark, skewed):
    items = K.cut_lineage(H.dense_index(skewed, "item"))
    got = G.sample_negatives(skewed, items, skewed, "user", "item", 25, 4).collect()
    seen, catalogue = {}, {r["item"] for r in skewed.collect()}
    for r in skewed.collect():
        seen.setdefault(r["user"], set()).add(r["item"])
    picked = {}
    for r in got:
        picked.setdefault(r["user"], []).append(r["item"])
    for user, mine in seen.items():
        mine_picked = picked.get(user, [])
        assert len(mine_picked) == len(set(mine_picked)) == min(25, len(catalogue - mine))
        assert not set(mine_picked) & mine


def test_sparsity_flags(spark):
    from prefmine.operators.profiles import sparsity_flags

    df = spark.createDataFrame([("x", 0.0062, 0.7, 0.9), ("y", 0.0001, 0.7, 0.1), ("z", 0.1, 0.1, 0.1)], "c string, density double, gini double, cold_ratio double")
    assert {r["c"]: r["type_flag"] for r in sparsity_flags(df).collect()} == {"x": "BC", "y": "AB", "z": "none"}


def test_instants_keep_their_hour_through_a_clock_change(spark):
    from prefmine.functions.scalars import any_timestamp

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2015-11-01 05:30:00+0000", "2015-11-01 06:30:00+0000", "Sun Nov 01 01:30:00 -0500 2015", "1960-03-01 00:00:00+0000"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r["p"] for r in df.select(F.date_format(any_timestamp("t"), "yyyy-MM-dd HH:mm:ss").alias("p")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2015-11-01 05:30:00", "2015-11-01 06:30:00", "2015-11-01 06:30:00", "1960-03-01 00:00:00"]


def test_null_keys_draw_by_place(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert df.select(K.hash_long(1, "x", "y")).distinct().count() == 2


def test_pairs_of_a_user_with_many_labels(spark):
    df = spark.range(2000).select(F.lit(1).alias("u"), F.col("id").cast("string").alias("label"))
    assert J.shared_users_by_pair(df, "u", "label").count() == 2000 * 1999 // 2


def test_simplex():
    from prefmine.plans.blending import simplex

    points = simplex(3, 0.05)
    assert len(points) == len(set(points)) == 231 and all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for p in points)


def test_histogram_with_an_open_end(spark):
    from prefmine.operators.profiles import equal_width_histogram

    df = spark.createDataFrame([(5,), (99,), (100_000,)], "v int")
    assert {r["bucket"]: r["n"] for r in equal_width_histogram(df, "v", 0, 100, 10, open_end=True).collect()} == {1: 1, 10: 2}


def test_walk_meets_every_unseen_item_in_its_order(spark, monkeypatch):
    monkeypatch.setattr(G, "WALK", 7)
    items = spark.createDataFrame([(i, 100 + i) for i in range(50)], "idx bigint, item bigint")
    seen = [(1, 100 + i) for i in range(0, 50, 2)] + [(2, 100 + i) for i in range(50)] + [(3, 999), (None, 101), (3, None)]
    wants = spark.createDataFrame([(1, 20), (2, 5), (3, 60), (4, 9), (None, 3)], "user bigint, want int")
    rows = G.unseen_walk(wants, items, spark.createDataFrame(seen + seen[:9], "user bigint, item bigint"), "user", "item", 4)
    got = {}
    for r in rows.collect():
        got.setdefault(r["user"], []).append((r["draw"], r["item"]))
    p = G.next_prime(50)
    starts = wants.select("user", "want", (K.hash_long(4, "user") % p).alias("a"), (1 + K.hash_long(5, "user") % (p - 1)).alias("b")).collect()
    for s in starts:
        steps = [(j + 1, (s["a"] + s["b"] * j) % p) for j in range(p)]
        free = [(j, 100 + i) for j, i in steps if i < 50 and (s["user"] is None or (s["user"], 100 + i) not in seen)]
        assert sorted(got.get(s["user"], [])) == free[: s["want"]]


def test_negatives_do_not_shuffle_steps(spark, skewed):
    items = K.cut_lineage(H.dense_index(skewed, "item"))
    plan = G.sample_negatives(skewed, items, skewed, "user", "item", 25, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "row_number" not in plan


def test_multiply_sums_a_row_in_one_task(spark):
    from prefmine.operators import joins as J

    a = spark.createDataFrame([(u, g, 1.0) for u in range(9) for g in range(4)], "user bigint, genre bigint, a double")
    b = spark.createDataFrame([(g, f"b{g % 2}", 2.0) for g in range(4)], "genre bigint, brand string, b double")
    out = J.multiply(a, b, "genre", ["user"], ["brand"], "a", "b", "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user" in plan
    assert {tuple(r) for r in out.collect()} == {(u, f"b{k}", 4.0) for u in range(9) for k in range(2)}
