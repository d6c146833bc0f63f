"""Saved models predict what the fitted ones predict."""

import pytest
from pyspark.sql import functions as F

from prefmine.core import cut_lineage
from prefmine.models import factors as Z
from prefmine.models import saved as V

UI = ("user", "item")


@pytest.fixture(scope="module")
def rows(spark):
    ids = spark.range(600)
    cells = ids.select((F.col("id") % 23).alias("user"), (F.col("id") * 7 % 17).alias("item"), (1 + F.col("id") * F.col("id") % 5).cast("double").alias("rating"))
    return cut_lineage(cells.dropDuplicates(["user", "item"]))


def asked(spark, rows):
    strangers = spark.createDataFrame([(999, 1), (1, 999), (999, 999)], "user bigint, item bigint")
    return rows.select(*UI).unionByName(strangers)


def values(df, out):
    return {(r["user"], r["item"]): None if r[out] is None else round(r[out], 9) for r in df.collect()}


def test_svd(spark, rows, tmp_path):
    model = Z.fit_svd(rows, *UI, "rating", k=3, rounds=2)
    V.save_svd(spark, model, str(tmp_path / "m"))
    loaded = V.load_svd(spark, str(tmp_path / "m"))
    test = asked(spark, rows)
    assert values(loaded.predict(test), "pred") == values(model.predict(test), "pred")
    assert loaded.share == model.share
    with pytest.raises(ValueError):
        V.load_factors(spark, str(tmp_path / "m"))


def test_factors(spark, rows, tmp_path):
    model = Z.fit_als(rows, *UI, "rating", rank=4, iterations=2, blocks=2)
    V.save_factors(spark, model, str(tmp_path / "m"))
    got = values(V.load_factors(spark, str(tmp_path / "m")).score(asked(spark, rows)), "score")
    assert got == values(model.score(asked(spark, rows)), "score")
    assert got[999, 1] is None
