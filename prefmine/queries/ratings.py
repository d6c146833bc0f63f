"""J and K: rating models and their errors."""

from pyspark.sql import functions as F

from prefmine.core import rnd, scratch_path, stored
from prefmine.datasets import KEY, ORDER, interactions
from prefmine.evaluation import ratings as E
from prefmine.models import means as M
from prefmine.models import saved as V
from prefmine.operators import graph as H
from prefmine.operators import profiles as P
from prefmine.plans import rating as R
from prefmine.plans import tuning as U
from prefmine.queries.graph import core_sql, split_sql
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query

K = ", ".join(KEY)
UI = ("user_id", "item_id")


def means_sql(train="tr", shrink=True):
    """g, um and im: global mean, user means and item means of a relation of training rows."""
    out = f", g AS (SELECT avg(rating) AS g FROM {train})"
    for alias, entity in (("um", "user_id"), ("im", "item_id")):
        out += f", {alias}_r AS (SELECT {entity}, avg(rating) AS r, count(*) AS n FROM {train} GROUP BY 1), {alias}_m AS (SELECT median(n) AS m FROM {alias}_r)"
        value = "(n * r + m * g) / (n + m)" if shrink else "r"
        out += f", {alias} AS (SELECT {entity}, n, r, {value} AS m FROM {alias}_r, {alias}_m x(m), g)"
    return out


PRED = ", p AS (SELECT te.*, um.m IS NOT NULL AS uk, im.m IS NOT NULL AS ik, least(greatest((COALESCE(um.m, g) + COALESCE(im.m, g)) / 2, 1.0), 5.0) AS pred FROM te LEFT JOIN um USING (user_id) LEFT JOIN im USING (item_id), g)"
SIDES = ", tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test')"
SUBSET = "CASE WHEN uk AND ik THEN 'warm' WHEN ik THEN 'cold_user' WHEN uk THEN 'cold_item' ELSE 'cold_both' END"
RMSE = "count(*) AS n, ROUND(sqrt(avg((rating - pred) * (rating - pred))), 6) AS rmse, ROUND(avg(abs(rating - pred)), 6) AS mae"


def raw_split(spark, d, share):
    rows = stored(interactions(spark, d).select(*dict.fromkeys([*ORDER, *KEY, *UI, "rating", "brand"])), "interactions")
    return R.sides(stored(H.temporal_split(rows, share, ORDER), "split"), *UI)


@query("j01_shrunk_means", means_sql("interactions") + """
SELECT 'user' AS kind, user_id AS id, n, ROUND(r, 6) AS raw_mean, ROUND(m, 6) AS mean FROM um UNION ALL SELECT 'item', item_id, n, ROUND(r, 6), ROUND(m, 6) FROM im
""")
def shrunk_means(spark, d):
    rows = interactions(spark, d)
    parts = [
        M.shrunk_means(rows, e, "rating").select(F.lit(k).alias("kind"), F.col(e).alias("id"), "n", rnd("raw_mean").alias("raw_mean"), rnd("mean").alias("mean"))
        for k, e in (("user", "user_id"), ("item", "item_id"))
    ]
    return parts[0].unionByName(parts[1])


@query("j02_mean_baseline", split_sql("interactions", 0.1) + SIDES + means_sql() + PRED + f" SELECT {K}, ROUND(pred, 6) AS pred FROM p")
def mean_baseline(spark, d):
    train, test = raw_split(spark, d, 0.1)
    return M.mean_baseline(train, test, *UI, "rating").select(*KEY, rnd("pred").alias("pred"))


@query("j02_raw_mean_baseline", split_sql("interactions", 0.1) + SIDES + means_sql(shrink=False) + PRED + f" SELECT {K}, ROUND(pred, 6) AS pred FROM p")
def raw_mean_baseline(spark, d):
    train, test = raw_split(spark, d, 0.1)
    return M.mean_baseline(train, test, *UI, "rating", shrink=False).select(*KEY, rnd("pred").alias("pred"))


@query("j02_saved_means", split_sql("interactions", 0.1) + SIDES + means_sql() + PRED + f" SELECT {K}, ROUND(pred, 6) AS pred FROM p")
def saved_means(spark, d):
    """Fitted, written, loaded, and only then asked."""
    train, test = raw_split(spark, d, 0.1)
    path = scratch_path(spark, "means-model")
    V.fit_means(train, *UI, "rating").save(spark, path)
    return V.load_means(spark, path).predict(test).select(*KEY, rnd("pred").alias("pred"))


@query("k01_scores", split_sql("interactions", 0.8) + SIDES + means_sql() + PRED + f" SELECT {RMSE} FROM p")
def scores(spark, d):
    train, test = raw_split(spark, d, 0.8)
    return rounded(E.scores(M.mean_baseline(train, test, *UI, "rating"), "rating", "pred"), "rmse", "mae")


@query("k02_subset_scores", core_sql(20) + split_sql("core", 0.8) + SIDES + means_sql() + PRED + f"""
SELECT {SUBSET} AS subset, {RMSE} FROM p GROUP BY 1 UNION ALL SELECT 'all', {RMSE} FROM p
""")
def subset_scores(spark, d):
    return rounded(R.baseline_report(interactions(spark, d), *UI, "rating", ORDER, 20), "rmse", "mae")


@query("k02_cold_scores", split_sql("interactions", 0.1) + SIDES + means_sql() + PRED + f"""
SELECT {SUBSET} AS subset, {RMSE} FROM p GROUP BY 1 UNION ALL SELECT 'all', {RMSE} FROM p
""")
def cold_scores(spark, d):
    train, test = raw_split(spark, d, 0.1)
    return rounded(E.subset_scores(M.mean_baseline(train, test, *UI, "rating"), "subset", "rating", "pred"), "rmse", "mae")


@query("k03_star_scores", split_sql("interactions", 0.8) + SIDES + means_sql() + PRED + f"""
, b AS (SELECT 'shrunk' AS model, rating, pred FROM p UNION ALL SELECT 'global', rating, (SELECT g FROM g) FROM te)
SELECT model, rating AS star, {RMSE} FROM b GROUP BY 1, 2
""")
def star_scores(spark, d):
    train, test = raw_split(spark, d, 0.8)
    rows = M.mean_baseline(train, test, *UI, "rating").withColumn("global", M.global_mean(train, "rating"))
    return rounded(E.star_scores(rows, "rating", {"shrunk": "pred", "global": "global"}), "rmse", "mae")


@query("k04_error_distribution", split_sql("interactions", 0.8) + SIDES + means_sql() + PRED + """
, e AS (SELECT abs(rating - pred) AS e FROM p)
SELECT count(*) AS n, ROUND(avg(e), 6) AS mean_error, ROUND(quantile_cont(e, 0.5), 6) AS p50, ROUND(quantile_cont(e, 0.9), 6) AS p90, ROUND(quantile_cont(e, 0.99), 6) AS p99,
       ROUND(avg(CASE WHEN e > 2 THEN 1.0 ELSE 0 END), 6) AS share_big FROM e
""")
def error_distribution(spark, d):
    train, test = raw_split(spark, d, 0.8)
    rows = M.mean_baseline(train, test, *UI, "rating")
    return rounded(E.error_distribution(rows, "rating", "pred", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), "mean_error", "p50", "p90", "p99", "share_big")


@query("k05_category_improvement", split_sql("interactions", 0.8) + SIDES + means_sql() + PRED + """
, c AS (SELECT brand, count(*) AS n, sqrt(avg(power(rating - (SELECT g FROM g), 2))) AS b, sqrt(avg(power(rating - pred, 2))) AS a FROM p GROUP BY brand HAVING count(*) >= 5),
l AS (SELECT brand, count(DISTINCT item_id) AS items FROM tr GROUP BY brand)
SELECT brand, n, items, ROUND(b, 6) AS rmse_before, ROUND(a, 6) AS rmse_after, ROUND(b - a, 6) + 0.0 AS improvement FROM c JOIN l USING (brand)
""")
def category_improvement(spark, d):
    train, test = raw_split(spark, d, 0.8)
    rows = M.mean_baseline(train, test, *UI, "rating").withColumn("global", M.global_mean(train, "rating"))
    labels = train.groupBy("brand").agg(F.countDistinct("item_id").alias("items"))
    out = E.category_improvement(rows, "brand", "rating", "global", "pred", labels)
    return rounded(out, "rmse_before", "rmse_after", "improvement")


@query("k05_improvement_by_flag", split_sql("interactions", 0.8) + SIDES + means_sql() + PRED + """
, f_i AS (SELECT brand, item_id, count(*) AS x FROM tr GROUP BY 1, 2), f_r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY x, item_id) AS k FROM f_i),
f_g AS (SELECT brand, 2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini FROM f_r GROUP BY brand),
f_u AS (SELECT brand, user_id, count(*) AS n FROM tr GROUP BY 1, 2), f_c AS (SELECT brand, avg(CASE WHEN n < 5 THEN 1.0 ELSE 0 END) AS cold_ratio FROM f_u GROUP BY brand),
f_b AS (SELECT brand, count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) AS density FROM tr GROUP BY brand),
l AS (SELECT brand, COALESCE(NULLIF((CASE WHEN density < .026 THEN 'A' ELSE '' END) || (CASE WHEN gini > .10 THEN 'B' ELSE '' END) || (CASE WHEN cold_ratio > .958 THEN 'C' ELSE '' END), ''), 'none') AS type_flag
      FROM f_b JOIN f_g USING (brand) JOIN f_c USING (brand)),
c AS (SELECT brand, sqrt(avg(power(rating - (SELECT g FROM g), 2))) AS b, sqrt(avg(power(rating - pred, 2))) AS a FROM p GROUP BY brand HAVING count(*) >= 5)
SELECT type_flag, count(*) AS categories, ROUND(avg(b - a), 6) + 0.0 AS mean_improvement FROM c JOIN l USING (brand) GROUP BY 1
""")
def improvement_by_flag(spark, d):
    train, test = raw_split(spark, d, 0.8)
    rows = M.mean_baseline(train, test, *UI, "rating").withColumn("global", M.global_mean(train, "rating"))
    flags = P.sparsity_flags(P.sparsity_metrics(train, "brand", *UI), 0.026, 0.10, 0.958).select("brand", "type_flag")
    per = E.category_improvement(rows, "brand", "rating", "global", "pred", flags)
    return rounded(E.improvement_by_label(per, "type_flag"), "mean_improvement")


# --------------------------------------------------------------------------- content, neighbours, factors

from prefmine.core import cut_lineage  # noqa: E402
from prefmine.models import content as C  # noqa: E402
from prefmine.models import factors as Z  # noqa: E402
from prefmine.models import neighbours as N  # noqa: E402
from prefmine.operators import features as X  # noqa: E402
from prefmine.operators import sampling as G  # noqa: E402
from prefmine.queries.features import VEC, vectors  # noqa: E402

CONTENT = split_sql("interactions", 0.8) + SIDES + means_sql(shrink=False) + PRED + VEC + """
, nu AS (SELECT item_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM e), us AS (SELECT user_id, pos, sum(x) AS x FROM tr JOIN nu USING (item_id) GROUP BY 1, 2),
uu AS (SELECT user_id, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY user_id)), 1e-12) AS x FROM us),
sm AS (SELECT user_id, item_id, sum(u.x * i.x) AS sim FROM (SELECT DISTINCT user_id, item_id FROM te) JOIN nu i USING (item_id) JOIN uu u USING (user_id, pos) WHERE item_id IN (SELECT item_id FROM tr) GROUP BY 1, 2),
ps AS (SELECT p.*, sim FROM p LEFT JOIN sm USING (user_id, item_id))
"""


def content_rows(spark, d):
    from prefmine.models.linalg import unit

    train, test = raw_split(spark, d, 0.8)
    items = vectors(spark, d).withColumn("vec", unit(F.col("vec"))).join(train.select("item_id").distinct(), "item_id", "left_semi")
    users = X.mean_profile(train, items, *UI, 64)
    return C.similarities(M.mean_baseline(train, test, *UI, "rating", shrink=False, out="base"), users, items, *UI)


@query("j03_content_model", CONTENT + f" SELECT {K}, ROUND(CASE WHEN sim IS NULL THEN pred ELSE least(greatest(pred + 0.25 * sim, 1), 5) END, 5) AS pred FROM ps")
def content_model(spark, d):
    return C.predict(content_rows(spark, d), "base", "sim", 0.25).select(*KEY, rnd("pred", 5).alias("pred"))


@query("j03_content_grid", CONTENT + """
, g2 AS (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS scale), q AS (SELECT rating, scale, CASE WHEN sim IS NULL THEN pred ELSE least(greatest(pred + scale * sim, 1), 5) END AS v FROM ps, g2)
SELECT scale, count(*) AS n, ROUND(sqrt(avg(power(rating - v, 2))), 6) AS rmse, ROUND(avg(abs(rating - v)), 6) AS mae, ROUND((SELECT avg(CASE WHEN sim IS NULL THEN 0.0 ELSE 1 END) FROM ps), 6) AS known_coverage FROM q GROUP BY scale
""")
def content_grid(spark, d):
    out = C.scale_grid(content_rows(spark, d), "base", "sim", "rating", C.CONTENT_SCALES)
    return rounded(out, "rmse", "mae", "known_coverage")


CF = split_sql("interactions", 0.8) + SIDES + means_sql(shrink=False) + PRED + """
, cc AS (SELECT user_id, item_id, CAST(sum(rating) AS DOUBLE) AS v FROM tr GROUP BY 1, 2), ct AS (SELECT *, v - avg(v) OVER (PARTITION BY user_id) AS c, avg(v) OVER (PARTITION BY user_id) AS um FROM cc),
sc AS (SELECT *, COALESCE(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY item_id)), 0), 0) AS x FROM ct),
pr AS (SELECT a.item_id, b.item_id AS neighbour, ROUND(sum(a.x * b.x), 9) AS sim, count(*) AS common FROM sc a JOIN sc b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
nb AS (SELECT * FROM pr WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbour) <= 20)
"""
KEYJ = " AND ".join(f"f.{k} = p.{k}" for k in KEY)


def cf_pred(name, mc, mn, sh, ms=0.0, nb="nb"):
    return f""", {name} AS (SELECT p.*, f.n IS NULL OR f.n < {mn} OR f.den <= 1e-12 AS fb, CASE WHEN f.n >= {mn} AND f.den > 1e-12 THEN least(greatest(f.um + f.num / f.den, 1), 5) ELSE p.pred END AS v FROM p LEFT JOIN
 (SELECT {', '.join('p.' + k for k in KEY)}, count(*) AS n, max(ct.um) AS um, sum(sim * common / (common + {sh}) * ct.c) AS num, sum(abs(sim * common / (common + {sh}))) AS den FROM p JOIN {nb} nb ON p.item_id = nb.item_id
  JOIN ct ON ct.user_id = p.user_id AND ct.item_id = nb.neighbour WHERE common >= {mc} AND sim > {ms} GROUP BY ALL) f ON {KEYJ})"""


def cf_parts(spark, d):
    train, test = raw_split(spark, d, 0.8)
    cells = cut_lineage(N.centred_cells(train, *UI, "rating"))
    near = cut_lineage(N.neighbours(cells, *UI, 20))
    rows = M.mean_baseline(train, test, *UI, "rating", shrink=False, out="base")
    return rows, near, N.matches(test, near, cells, *UI, KEY)


@query("j04_item_neighbours", CF + " SELECT item_id, neighbour, ROUND(sim, 6) AS sim, common FROM nb")
def item_neighbours(spark, d):
    train, _ = raw_split(spark, d, 0.8)
    return N.neighbours(cut_lineage(N.centred_cells(train, *UI, "rating")), *UI, 20).withColumn("sim", rnd("sim"))


@query("j04_bounded_neighbours", CF.replace("sim DESC, neighbour) <= 20)", "sim DESC, neighbour) <= 20), nr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbour) AS rank FROM nb)")
       + " SELECT item_id, neighbour, ROUND(sim, 6) AS sim, common, rank::INT AS rank FROM nr")
def bounded_neighbours(spark, d):
    train, _ = raw_split(spark, d, 0.8)
    return N.bounded_neighbours(cut_lineage(N.centred_cells(train, *UI, "rating")), *UI, 20).withColumn("sim", rnd("sim"))


@query("j04_item_cf", CF + cf_pred("r", 1, 1, 2.0) + f" SELECT {K}, ROUND(v, 5) AS pred, fb AS fallback FROM r")
def item_cf(spark, d):
    rows, _, found = cf_parts(spark, d)
    out = N.predict(rows, found, KEY, "base", 1, 1, 2.0)
    return out.select(*KEY, rnd("pred", 5).alias("pred"), "fallback")


_GRID = [{"min_common": mc, "min_neighbours": mn, "shrink": sh} for mc in (1, 2) for mn in (1, 2) for sh in (0.0, 2.0)]


@query("j05_cf_grid", CF + "".join(cf_pred(f"r{i}", g["min_common"], g["min_neighbours"], g["shrink"]) for i, g in enumerate(_GRID)) + " UNION ALL ".join(
    f" SELECT {float(g['min_common'])}::DOUBLE AS min_common, {float(g['min_neighbours'])}::DOUBLE AS min_neighbours, {g['shrink']}::DOUBLE AS shrink, count(*) AS n, ROUND(sqrt(avg(power(rating - v, 2))), 6) AS rmse, ROUND(avg(abs(rating - v)), 6) AS mae, ROUND(avg(CASE WHEN fb THEN 1.0 ELSE 0 END), 6) AS fallback_rate FROM r{i}"
    for i, g in enumerate(_GRID)))
def cf_grid(spark, d):
    rows, _, found = cf_parts(spark, d)
    return rounded(N.tune(rows, found, KEY, "base", "rating", _GRID), "rmse", "mae", "fallback_rate")


_FULL = [{"top_k": k, "min_common": mc, "min_neighbours": mn, "shrink": sh, "min_sim": ms} for k in (10, 20) for mc in (1, 2) for mn in (1, 3) for sh in (2.0, 10.0) for ms in (0.0, 0.1)]
_CUT = "".join(f", nb{k} AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbour) <= {k})" for k in (10, 20))


@query("j05_cf_full_grid", CF + _CUT + "".join(cf_pred(f"r{i}", g["min_common"], g["min_neighbours"], g["shrink"], g["min_sim"], f"nb{g['top_k']}") for i, g in enumerate(_FULL)) + " UNION ALL ".join(
    " SELECT " + ", ".join(f"{float(v)}::DOUBLE AS {n}" for n, v in g.items()) + f", count(*) AS n, ROUND(sqrt(avg(power(rating - v, 2))), 6) AS rmse, ROUND(avg(abs(rating - v)), 6) AS mae, ROUND(avg(CASE WHEN fb THEN 1.0 ELSE 0 END), 6) AS fallback_rate FROM r{i}"
    for i, g in enumerate(_FULL)))
def cf_full_grid(spark, d):
    """All five axes from one table of ranked neighbours."""
    train, test = raw_split(spark, d, 0.8)
    cells = cut_lineage(N.centred_cells(train, *UI, "rating"))
    near = stored(N.bounded_neighbours(cells, *UI, 20), "neighbours")
    rows = M.mean_baseline(train, test, *UI, "rating", shrink=False, out="base")
    return rounded(N.tune(rows, N.matches(test, near, cells, *UI, KEY), KEY, "base", "rating", _FULL), "rmse", "mae", "fallback_rate")


@query("j06_residual_factors")
def residual_factors(spark, d):
    train, test = raw_split(spark, d, 0.8)
    model = Z.fit_residual(cut_lineage(train.select(*UI, "rating")), *UI, "rating")
    return rounded(E.scores(model.predict(test), "rating", "pred"), "rmse", "mae", digits=4)


@query("j07_implicit_rating")
def implicit_rating(spark, d):
    train, test = raw_split(spark, d, 0.8)
    factors = Z.fit_implicit(train, *UI, rank=20, iterations=10, reg=0.01)
    rows = factors.score(M.mean_baseline(train, test, *UI, "rating", shrink=False, out="base"))
    # Coarse residual scales.
    coarse = [-0.50, -0.25, -0.10, -0.05, 0.00, 0.01, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20, 0.30, 0.50, 0.75, 1.00]
    return rounded(C.scale_grid(cut_lineage(rows.select("rating", "base", "score")), "base", "score", "rating", coarse), "rmse", "mae", "known_coverage", digits=4)


def inner_split(spark, d):
    """Training rows up to the last tenth of the training side, and that tenth."""
    folds = stored(H.temporal_split(raw_split(spark, d, 0.8)[0].drop("split"), 0.9, ORDER), "folds")
    return folds.filter("split = 'train'"), folds.filter("split = 'test'")


@query("j06_gradient_grid")
def gradient_grid(spark, d):
    return rounded(U.gradient_grid(*inner_split(spark, d)), "rmse", "mae", "known_coverage", "train_rmse", digits=4)


@query("j07_implicit_grid")
def implicit_grid(spark, d):
    return rounded(U.implicit_grid(*inner_split(spark, d)), "rmse", "mae", "known_coverage", digits=4)


@query("j09_explicit_als")
def explicit_als(spark, d):
    train, test = raw_split(spark, d, 0.8)
    factors = Z.fit_als(stored(X.utility_matrix(train, *UI, "rating", "avg"), "cells"), *UI)
    rows = factors.score(test).withColumn("pred", F.coalesce("score", M.global_mean(train, "rating")))
    return rounded(E.scores(rows, "rating", "pred"), "rmse", "mae", digits=4)


@query("j10_centred_svd")
def centred_svd(spark, d):
    train, test = raw_split(spark, d, 0.8)
    model = Z.fit_svd(cut_lineage(train.select(*UI, "rating")), *UI, "rating")
    return rounded(E.subset_scores(model.predict(test), "subset", "rating", "pred"), "rmse", "mae", digits=4)


@query("j11_resampled_comparison")
def resampled_comparison(spark, d):
    train, test = raw_split(spark, d, 0.8)
    train = cut_lineage(train.select(*KEY, "user_id", "brand", "rating"))
    warm = cut_lineage(test.filter("subset = 'warm'").select(*UI, "rating"))
    flags = P.sparsity_flags(P.sparsity_metrics(train, "brand", "user_id", "item_id"), 0.026, 0.10, 0.958)
    again = cut_lineage(G.resample(train, flags, "brand", *UI, KEY))
    preds = {
        "mean_baseline": M.mean_baseline(train, warm, *UI, "rating", shrink=False),
        "svd_raw": Z.fit_svd(train, *UI, "rating").predict(warm),
        "svd_resampled": Z.fit_svd(again, *UI, "rating").predict(warm),
    }
    parts = [p.select("rating", "pred", F.lit(n).alias("model")) for n, p in preds.items()]
    out = E.scores(parts[0].unionByName(parts[1]).unionByName(parts[2]), "rating", "pred", ["model"])
    return rounded(out, "rmse", "mae", digits=4)
