"""Models against numpy and hand-computed cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmine.core import cut_lineage
from prefmine.evaluation import ranking as R
from prefmine.models import ensemble as E
from prefmine.models import linalg as L
from prefmine.models import neighbours as N


def test_truncated_svd(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 5)) @ rng.normal(size=(5, 12)) + 0.01 * rng.normal(size=(30, 12))
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12)], "r bigint, c bigint, v double")
    rows, cols, singular, share, residuals = L.truncated_svd(entries, "r", "c", "v", 3, rounds=20, tol=1e-4)
    u, s, vt = np.linalg.svd(a)
    assert np.allclose(singular, s[:3], rtol=1e-3)
    assert math.isclose(share, float((s[:3] ** 2).sum() / (s**2).sum()), rel_tol=1e-3)
    got = np.array([r["vec"] for r in rows.orderBy("r").collect()]) @ np.array([r["vec"] for r in cols.orderBy("c").collect()]).T
    assert np.allclose(got, (u[:, :3] * s[:3]) @ vt[:3], atol=1e-2)
    v = np.array([r["vec"] for r in cols.orderBy("c").collect()])
    us = np.array([r["vec"] for r in rows.orderBy("r").collect()])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8) and np.allclose(us.T @ us, np.diag(singular**2), atol=1e-6)
    assert residuals.max() <= 1e-4 and np.linalg.norm(a.T @ (us / singular) - v * singular, axis=0).max() < 1e-3 * s[0]
    assert L.truncated_svd(entries, "r", "c", "v", 3, rounds=1).residuals.max() > 1e-4


def test_svd_products_in_every_grid(spark, monkeypatch):
    """Ids are strings, cells repeat, and a row and a column are null: what they have is read as nothing, as a join on them would."""
    rng = np.random.default_rng(3)
    cells = [(None if i == 4 else f"r{i}", None if j == 6 else f"c{j}", float(rng.normal())) for i, j in rng.integers(0, (9, 7), size=(60, 2)).tolist()]
    entries = spark.createDataFrame(cells, "r string, c string, v double")
    monkeypatch.setattr(L, "PACKED", 2)
    monkeypatch.setattr(L, "PACKED_CELLS", 8)
    packed = []
    write = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: packed.append((name, out := write(df, name))) or out)
    found = []
    for grid in (L._Grid(2, 1, True), L._Grid(2, 1, False), L._Grid(3, 4, True), L._Grid(3, 2, False)):
        monkeypatch.setattr(L._Grid, "of", classmethod(lambda *_: grid))
        out = L.truncated_svd(entries, "r", "c", "v", 2, rounds=2)
        u, v = ({r[0]: np.array(r[1]) for r in side.collect()} for side in (out.rows, out.cols))
        found.append((out.singular, u, v))
    for _, u, v in found:
        for name, vec in u.items():
            assert np.allclose(vec, sum(x * v[c] for r, c, x in cells if r == name and c is not None))
    assert all(np.allclose(s, found[0][0]) and all(np.allclose(v[c] @ v[c], found[0][2][c] @ found[0][2][c]) for c in v) for s, _, v in found)
    assert {n for n, _ in packed} == {"svd-index", "svd-cells", "svd-vectors"}


def test_svd_vectors_are_shuffled_by_block():
    """1.2 million items and 0.9 million users with 29 million cells: three times each, where partial sums would travel nearly once per cell."""
    grid = L._Grid.of(29_000_000, 900_000, 1_200_000, 54)
    assert grid.side * grid.slices == 3 and grid.whole
    assert L._Grid.of(0, 0, 0, 54).slices == 1
    large = L._Grid.of(173_000_000, 5_400_000, 7_200_000, 54)
    assert large.side < 9 and large.slices < 9


def test_positive_ridge_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=(40, 4)), rng.normal(size=40)
        a, b = x.T @ x, x.T @ y
        w = L.positive_ridge(a, b, 1.0)
        slope = (a + np.eye(4)) @ w - b
        assert (w >= 0).all() and (slope > -1e-8).all() and np.abs(slope * w).max() < 1e-8


def test_ridges_match_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    fits = E.fit_ridges(df, ["a", "b", "c"], F.col("y"), [0.1, 5.0])
    for alpha, (w, b) in fits.items():
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert np.allclose(w, want) and math.isclose(b, y.mean() - want @ x.mean(0), abs_tol=1e-9)


def test_bounded_neighbours_form_fewer_pairs(spark):
    """Small tight groups of items, a few users who rate nearly everything, users with one constant rating and repeated sims."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        likes = rng.choice([-1, 1], size=6)
        for u in range(8):
            for i in range(6):
                if rng.random() < 0.9:
                    rows.append((g * 8 + u, g * 6 + i, float(3 + 2 * likes[i] * (1 if u % 2 else -1) + rng.normal() * 0.1)))
    for u in range(5):
        rows += [(10_000 + u, i, 3.0 + 0.2 * float(rng.normal())) for i in range(180) if rng.random() < 0.9]
    rows += [(20_000, i, 4.0) for i in range(0, 180, 7)]
    cells = cut_lineage(N.centred_cells(spark.createDataFrame(rows, "user bigint, item bigint, rating double"), "user", "item", "rating"))
    for k in (1, 3):
        want = {tuple(r) for r in N.neighbours(cells, "user", "item", k).select("item", "neighbour", "sim", "common").collect()}
        got = N.bounded_neighbours(cells, "user", "item", k, chunk=50)
        assert {tuple(r) for r in got.drop("rank").collect()} == want
        assert got.groupBy("item").agg(F.max("rank").alias("m"), F.count("*").alias("n")).filter("m <> n").count() == 0
    split = N.split_cells(cells, "user", "item", 2)
    formed, whole = split.agg(F.sum(F.when(~F.col("head") & (F.col("x") != 0), F.col("items"))), F.sum("items")).first()
    assert formed < whole / 2
    empty = N.bounded_neighbours(cells.limit(0), "user", "item", 3)
    assert empty.count() == 0


def test_neighbours_by_hand(spark):
    ratings = {1: {10: 5, 20: 4, 30: 1}, 2: {10: 4, 20: 5, 30: 2}, 3: {10: 1, 20: 2, 30: 5}, 4: {10: 5, 30: 3}}
    rows = [(u, i, r) for u, items in ratings.items() for i, r in items.items()]
    train = spark.createDataFrame(rows, "user bigint, item bigint, rating int")
    cells = N.centred_cells(train, "user", "item", "rating")
    mean = {u: np.mean(list(v.values())) for u, v in ratings.items()}
    vec = {i: np.array([ratings[u].get(i, mean[u]) - mean[u] for u in ratings]) for i in (10, 20, 30)}
    want = {}
    for i, j in itertools.permutations(vec, 2):
        s = float(vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j]))
        if s > 0:
            want[i, j] = round(s, 6)
    got = {(r["item"], r["neighbour"]): round(r["sim"], 6) for r in N.neighbours(cells, "user", "item").collect()}
    assert got == want
    test = spark.createDataFrame([(4, 20, 3.0), (4, 30, 3.0)], "user bigint, item bigint, base double")
    found = N.matches(test, N.neighbours(cells, "user", "item"), cells, "user", "item", ["user", "item"])
    out = {r["item"]: r for r in N.predict(test, found, ["user", "item"], "base", 1, 1, 0.0).collect()}
    assert math.isclose(out[20]["pred"], min(5.0, mean[4] + (5 - mean[4]))) and not out[20]["fallback"]
    assert out[30]["pred"] == 3.0 and out[30]["fallback"]


def test_recall_and_ndcg_by_hand(spark):
    rows = [("a", 1, 0.9, 1), ("a", 2, 0.8, 0), ("a", 3, 0.7, 1), ("a", 4, 0.1, 1), ("b", 1, 0.2, 0), ("b", 2, 0.1, 1)]
    df = spark.createDataFrame(rows, "user string, item bigint, s double, pos int")
    got = {r["user"]: r for r in R.user_metrics(df, "user", "item", "s", "pos", (1, 3)).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert math.isclose(got["a"]["recall_3"], 2 / 3) and math.isclose(got["a"]["ndcg_3"], (1 + 1 / 2) / ideal)
    assert got["a"]["recall_1"] == 1.0 and got["b"]["recall_1"] == 0.0 and math.isclose(got["b"]["ndcg_3"], 1 / math.log2(3))


@pytest.mark.parametrize("value", [None, 0.0, 3.0, 9.0])
def test_clip_keeps_null(spark, value):
    from prefmine.functions.scalars import clip

    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(clip("x", 1.0, 5.0).alias("x")).first()["x"] == (None if value is None else min(max(value, 1.0), 5.0))


def test_topic_queries_keep_vocabulary_and_passes(spark, sf_dir, monkeypatch):
    from prefmine.models import topics
    from prefmine.queries import taste

    asked = []
    count, lda = topics.CountVectorizer, topics.LDA
    monkeypatch.setattr(topics, "CountVectorizer", lambda **k: asked.append(k["vocabSize"]) or count(**k))
    monkeypatch.setattr(topics, "LDA", lambda **k: asked.append(k["maxIter"]) or lda(**k))
    for made in (taste.lda_topics, taste.topic_terms, taste.book_topics):
        assert made(spark, sf_dir).count() > 0
    assert asked == [50_000, 10, 10, 50_000, 10, 50_000, 10]  # words are counted once for both numbers of topics


def _cells(spark, seed=11):
    rng = np.random.default_rng(seed)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(40) for i in range(30) if u == 0 or i == 0 or rng.random() < 0.3]
    return rows, cut_lineage(N.centred_cells(spark.createDataFrame(rows, "u bigint, i bigint, r double"), "u", "i", "r"))


def test_neighbours_of_hot_users_and_items_without_a_table_of_pairs(spark):
    """User 0 rates all items, item 0 is rated by all users; lists are cut and item 0 is spread over tasks."""
    rows, cells = _cells(spark)
    a = np.zeros((40, 30))
    has = np.zeros((40, 30), bool)
    for u, i, r in rows:
        a[u, i], has[u, i] = r, True
    c = np.where(has, a - (a.sum(1) / has.sum(1))[:, None], 0.0)
    c = c / np.sqrt((c * c).sum(0))
    want = {}
    for i in range(30):
        sims = sorted((-round(float(c[:, i] @ c[:, j]), 9), j, int((has[:, i] & has[:, j]).sum())) for j in range(30) if j != i)
        want |= {(i, j): (-s, n) for s, j, n in sims[:5] if s < 0}
    for chunk, task_pairs in ((1000, 2_000_000), (7, 150), (7, 500), (1000, 1)):
        got = N.neighbours(cells, "u", "i", 5, chunk, task_pairs)
        assert {(r["i"], r["neighbour"]): (round(r["sim"], 8), r["common"]) for r in got.collect()} == {k: (round(s, 8), n) for k, (s, n) in want.items()}
    near = N.neighbours(cells, "u", "i", 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "neighbour" in line or "item_b" in line], "pairs are shuffled"


def test_matches_equal_joins_without_a_row_per_neighbour(spark):
    """User 0 has several lists; a user and an item are unknown, and one pair is asked twice."""
    _, cells = _cells(spark)
    near = cut_lineage(N.neighbours(cells, "u", "i", 5))
    rows = spark.createDataFrame([(k, u, i) for k, (u, i) in enumerate([(0, i) for i in range(32)] + [(u, 3) for u in range(45)] + [(0, 3), (None, 3), (3, None)])], "k bigint, u bigint, i bigint")
    rated = cells.select("u", F.col("i").alias("neighbour"), "centred", "user_mean")
    want = rows.join(near, "i").join(rated, ["u", "neighbour"])
    for chunk in (1000, 7):
        got = N.matches(rows, near, cells, "u", "i", ["k"], chunk)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.columns.count("i") == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1


def test_lists_travel_once_per_task(spark, monkeypatch):
    """With two tasks a user's list is there twice at most, whatever the number of the user's items; ids that are no numbers, and null ones, give the same."""
    _, cells = _cells(spark)
    tables, summed = spark.sparkContext.accumulator(0), N._summed

    def counted(table, *rest):
        tables.add(table.num_rows)
        return summed(table, *rest)

    monkeypatch.setattr(N, "_summed", counted)
    want = {tuple(r) for r in N.neighbours(cells, "u", "i", 5, task_pairs=200, chunk=1000).collect()}
    assert want and 0 < tables.value
    pairs = cells.groupBy("u").count().agg(F.sum(F.col("count") ** 2)).first()[0]
    assert tables.value <= 40 * -(-pairs // (N.TIMES * 200)) < cells.count()
    named = cells.withColumn("i", F.format_string("%03d", "i")).unionByName(cells.limit(1).withColumn("i", F.lit(None).cast("string")))
    got = {(int(r[0]), int(r[1]), *r[2:]) for r in N.neighbours(named, "u", "i", 5).collect()}
    assert {(a, b, c) for a, b, _, c in got} == {(a, b, c) for a, b, _, c in want}


def test_tune_scores_as_predict_and_joins_once(spark):
    rows, cells = _cells(spark)
    near = cut_lineage(N.bounded_neighbours(cells, "u", "i", 5))
    test = spark.createDataFrame([(k, u, i, float(1 + (u + i) % 5), 3.0) for k, (u, i) in enumerate(itertools.product(range(0, 45, 2), range(0, 33, 3)))], "k bigint, u bigint, i bigint, rating double, base double")
    found = cut_lineage(N.matches(test, near, cells, "u", "i", ["k"]))
    grid = [{"top_k": k, "min_common": mc, "min_neighbours": mn, "shrink": sh, "min_sim": ms} for k in (2, 5) for mc in (1, 9) for mn in (1, 3) for sh in (0.0, 10.0) for ms in (0.0, 0.1)]
    out = N.tune(test, found, ["k"], "base", "rating", grid)
    got = {tuple(r[n] for n in grid[0]): r for r in out.collect()}
    assert len(got) == len(grid)
    for point in grid[::5]:
        scored = N.predict(test, found, ["k"], "base", **point)
        error = F.col("rating") - F.col("pred")
        want = scored.agg(F.count(F.lit(1)), F.sqrt(F.avg(error * error)), F.avg(F.abs(error)), F.avg(F.col("fallback").cast("double"))).first()
        r = got[tuple(float(v) for v in point.values())]
        assert r["n"] == want[0] and np.allclose([r["rmse"], r["mae"], r["fallback_rate"]], list(want)[1:])
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(out) == joins(N.tune(test, found, ["k"], "base", "rating", grid[:1])) == 1


def test_solver_blocks_follow_cores_and_cells(spark, monkeypatch):
    """A vector is shuffled once per block, so blocks must not follow the number of shuffle partitions."""
    from prefmine.models import factors as Z

    cells = spark.range(1000).selectExpr("id % 50 AS u", "id % 37 AS i", "1.0D AS value")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    cores = max(10, spark.sparkContext.defaultParallelism)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "400")
        assert Z.solver_blocks(cells) == cores
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert Z.solver_blocks(cells) == 4
        monkeypatch.setattr(Z, "BLOCK_CELLS", 50)
        assert Z.solver_blocks(cells) == 20
        monkeypatch.setattr(Z, "BLOCK_CELLS", 500)
        spark.conf.set("spark.sql.shuffle.partitions", "400")
        assert Z.solver_blocks(cells, 87, 20) == cores
        # large tables of vectors: as many blocks as the bytes of a half round allow, or the few that are asked for
        monkeypatch.setattr(Z, "ROUND_BYTES", 87 * 20 * 4 * 5)
        assert [Z.solver_blocks(cells, 87, rank, few) for rank, few in ((20, 4), (50, 4), (50, 2), (100, 1))] == [5, 4, 2, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bounded_neighbours_write_few_candidates(spark, monkeypatch):
    """Without bounds from the first pass the k-th best of what an item has met is one."""
    _, cells = _cells(spark)
    sizes = {}
    write = N.stored

    def recorded(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(N, "stored", recorded)
    got = N.bounded_neighbours(cells, "u", "i", 3, seed_share=0.0)
    assert got.count() and sizes["candidates"] <= 30 * 3 + 10


def test_cell_products_equal_joins(spark, monkeypatch):
    monkeypatch.setattr(L, "CELL_PAIRS", 3)
    rng = np.random.default_rng(5)
    vecs = [(i, rng.normal(size=6).tolist()) for i in range(9)] + [(3, [1.0] * 6), (9, [0.0] * 6), (10, None), (11, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6)]
    v = spark.createDataFrame(vecs, "id bigint, vec array<float>")
    pairs = spark.createDataFrame([(i % 12, i * 5 % 13, f"p{i}") for i in range(60)] + [(None, 1, "x"), (1, None, "y")], "u int, i bigint, name string")
    users, items = v.withColumnRenamed("id", "u"), v.withColumnRenamed("id", "i")
    got = L.cell_products(pairs, users, items, "u", "i", "vec", {"all": (None, False), "half": (3, True)}, 60)
    joined = pairs.join(items.withColumnRenamed("vec", "vi"), "i").join(users.withColumnRenamed("vec", "vu"), "u")
    half = lambda c: F.slice(F.col(c).cast("array<double>"), 1, 3)
    want = joined.select("u", "i", "name", L.dot(F.col("vu"), F.col("vi")).alias("all"), L.cosine(half("vu"), half("vi")).alias("half"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.schema["u"].dataType == pairs.schema["u"].dataType


def test_blend_and_metrics_shuffle_once_by_user(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.1, 1), (1, 2, 0.6, None, 0), (2, 1, 0.4, 0.3, 1)], "user bigint, item bigint, als double, taste double, pos int")
    out = R.user_metrics(R.blend_scores(df, "user", "als", "taste", [1.0, 0.3]), "user", "item", "final", "pos", keys=["alpha"])
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert out.count() == 4
