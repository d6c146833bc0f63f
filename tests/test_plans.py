"""What reaches the scan, and what the readers and writers promise."""

import pytest
from pyspark.sql import functions as F

from prefmine.core import scratch_path
from prefmine.datasets import interactions
from prefmine.functions.text import normalise_text, strip_tags, word_count
from prefmine.plans.books import prepared
from prefmine.sources import readers as R
from prefmine.sources import sinks as K
from prefmine.sources.schemas import require


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(interactions(spark, sf_dir).filter("order_key > 100").groupBy("brand").agg(F.avg("rating")))
    scans = [line for line in text.splitlines() if "ReadSchema" in line]
    lines = next(s for s in scans if "l_quantity" in s)
    assert "l_tax" not in lines and "l_discount" not in lines and "GreaterThan(l_orderkey,100)" in lines


def test_partition_pruning(spark, sf_dir):
    path = scratch_path(spark, "prune")
    K.write_partitioned(interactions(spark, sf_dir).select("user_id", F.col("rating").alias("overall")), path, "overall")
    text = plan(R.read_hive_rating(spark, path).filter("overall = 3"))
    assert "PartitionFilters: [isnotnull(overall" in text and "(overall#" in text


def test_corrupt_tsv_rows_are_kept(spark):
    path = scratch_path(spark, "tsv")
    header = "\t".join(f.name for f in R.RETAIL_REVIEW.fields)
    good = "\t".join(["US", "1", "R1", "P1", "X", "title", "Books", "5", "1", "2", "N", "Y", "head", '"body\nwith ""quotes"""', "2015-01-02"])
    bad = "\t".join(["US", "1", "R2", "P1", "X", "title", "Books", "five", "1", "2", "N", "Y", "head", "body", "2015-01-02"])
    spark.createDataFrame([("\n".join([header, good, bad]),)], "value string").coalesce(1).write.text(path)
    rows = {r["review_id"]: r for r in R.read_tsv(spark, path).collect()}
    assert rows["R1"]["review_body"] == 'body\nwith "quotes"' and rows["R1"]["_corrupt_record"] is None
    assert rows["R2"]["star_rating"] is None and rows["R2"]["_corrupt_record"]


def test_inventory_reports_unreadable_files(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    rows = {r["readable"]: r for r in R.inventory(spark, str(tmp_path)).collect()}
    assert rows[True]["rows"] == 10 and rows[False]["rows"] is None and rows[False]["bytes"] == 11


def test_html_is_unescaped(spark):
    df = spark.createDataFrame([("<p>a &amp;  b</p>\n&lt;c&gt; &eacute;",), (None,), ("plain",)], "t string")
    assert [r["t"] for r in normalise_text(df, "t").collect()] == ["a & b é", None, "plain"]


def test_missing_columns_fail_early(spark):
    with pytest.raises(ValueError, match="b"):
        require(spark.range(1), {"id", "b"})
    with pytest.raises(ValueError):
        R.load_data(spark, "x", "orc")


def test_pairs_are_scored_once(spark, sf_dir):
    """One product of the vectors and a sum per stage (softplus names it twice); no copy of them in a filter that asks whether a pair has scores."""
    from prefmine.queries import load

    text = load()[0]["o03_chain_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("zip_with(") == 1 + 2 * 4


def test_plain_entities_are_unescaped_as_by_python(spark):
    import html

    texts = ["a &amp; b", "&amp;lt;i&amp;gt;", "&lt;b&gt;x&lt;/b&gt; y", "&quot;q&#39;", "&amp;amp;", "&AMP; &nbsp;z", "x&amp;y &eacute;", "&", "a&b", "&amp", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = strip_tags(F.col("u"))
    wanted = spark.createDataFrame([(i, None if t is None else html.unescape(t)) for i, t in enumerate(texts)], "i int, u string").select("i", plain.alias("t"))
    assert sorted(normalise_text(df, "t").collect()) == sorted(wanted.collect())


def test_word_counts(spark):
    texts = ["", " ", "\t", "a", " a  b\n", "a b c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [0, 0, 0, 1, 2, 2, None]


def test_books_are_cleaned_once(spark):
    rows = [(f"r{i}", "u", f"b{i % 3}", "5", "so &nbsp;so <br/>" * (i + 1), str(i), "Thu Jan 01 00:00:00 +0000 1998", "g") for i in range(8)]
    df = spark.createDataFrame(rows, "review_id string, user_id string, book_id string, rating string, review_text string, n_votes string, date_added string, primary_genre string")
    out = prepared(df, (1999,), 2000, 2000, 1, 1, 1999, 4)
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["review_id"]: (r["review_token_count"], r["review_text"]) for r in out.collect()}
    assert got == {f"r{i}": (2 * (i + 1), " ".join(["so  so"] * (i + 1)) if False else got[f"r{i}"][1]) for i in range(1, 8)}


def test_texts_are_dealt_by_size(spark, monkeypatch):
    from prefmine.plans import taste as T

    df = spark.createDataFrame([(i // 2, f"apple pear{'abc'[i % 3]} plum apple cherry " * 4) for i in range(60)], "k bigint, t string").coalesce(1)
    whole = T.filtered_bags(T.document_tokens(df, ["k"], "t"), ["k"], 1, 1.0, 100)
    monkeypatch.setattr(T, "TASK_CHARS", 500)
    docs = T.document_tokens(df, ["k"], "t")
    assert docs.rdd.getNumPartitions() > 8
    assert sorted(T.filtered_bags(docs, ["k"], 1, 1.0, 100).collect()) == sorted(whole.collect())


def test_terms_are_admitted_as_from_all_counts(spark):
    import random
    from collections import Counter

    from prefmine.operators.features import admitted_terms

    draw = random.Random(3)
    rows = [(draw.randrange(12), f"w{min(draw.randrange(60), draw.randrange(60))}") for _ in range(3000)]
    rows += [(i, "every") for i in range(12) for _ in range(40)] + [(None, "w0"), (1, "once"), (2, "often")] + [(2, "often")] * 200
    tf = Counter(rows)
    df, total = Counter(t for _, t in tf), Counter()
    for (_, t), n in tf.items():
        total[t] += n
    kept = sorted((-total[t], t) for t in total if 2 <= df[t] <= 0.95 * 12)
    terms = spark.createDataFrame(rows, "item bigint, term string")
    for k, at_first in ((5, 1), (8, 4), (200, 1)):
        counts, vocab = admitted_terms(terms, "item", F.lit(12), 2, 0.95, k, at_first)
        assert sorted((-r["total"], r["term"]) for r in vocab.collect()) == kept[:k]
        assert all(r["df"] == df[r["term"]] for r in vocab.collect())
        got = {(r["item"], r["term"]): r["tf"] for r in counts.collect()}
        assert all(tf[c] == n for c, n in got.items())
        assert {c for c in tf if c[1] in {t for _, t in kept[:k]}} <= set(got)
    few, _ = admitted_terms(terms, "item", F.lit(12), 1, 1.0, 5, 2)
    assert few.select("term").distinct().count() < len(total) / 2


def test_topic_tokens_are_stored_by_column(spark, sf_dir):
    from prefmine.queries.taste import tokenised

    assert all("tokens-" in f for f in tokenised(spark, sf_dir).inputFiles())


def test_rating_queries_store_the_columns_they_read(spark, sf_dir, monkeypatch):
    from prefmine.operators import graph
    from prefmine.plans import rating
    from prefmine.queries import load, ratings

    written = []
    for module in (graph, rating, ratings):
        write = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, write=write: written.append((name, set(df.columns))) or write(df, name))
    assert load()[0]["k02_subset_scores"](spark, sf_dir).count() > 0
    assert {"log", "edges", "core"} <= {n for n, _ in written}
    train, _ = ratings.raw_split(spark, sf_dir, 0.8)
    assert train.count() > 0 and all(not c & {"title", "genre", "price"} for _, c in written)
