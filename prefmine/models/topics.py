"""Topic models and clusters with Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.core import cut_lineage, stored
from prefmine.operators.features import min_max
from prefmine.plans.taste import window_coherence

# Numbers of topics that are tried.
TOPIC_COUNTS = (30, 40)


class Topics:
    def __init__(self, model, vectorizer, docs: DataFrame, k: int):
        self.model, self.vectorizer, self.docs, self.k = model, vectorizer, docs, k

    def top_terms(self, n: int = 10) -> DataFrame:
        """(topic, rank, term, weight) of the ``n`` heaviest terms per topic."""
        terms = self.docs.sparkSession.createDataFrame(list(enumerate(self.vectorizer.vocabulary)), "at int, term string")
        raw = self.model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
        named = raw.join(terms, F.col("t.termIndices") == F.col("at"))
        return named.select("topic", "rank", "term", F.col("t.termWeights").alias("weight"))

    def vectors(self, key: list[str]) -> DataFrame:
        return self.model.transform(self.docs).select(*key, vector_to_array("topicDistribution").alias("vec"))


def bags(docs: DataFrame, min_df: float = 20, max_df: float = 0.4, vocabulary: int = 50_000):
    """(vectorizer, stored rows with term counts); very rare and very common words are left out."""
    vectorizer = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocabulary, minDF=min_df, maxDF=max_df).fit(docs)
    return vectorizer, stored(vectorizer.transform(docs), "bags")


def fit_topics(docs: DataFrame, k: int, passes: int = 10, seed: int = 42, counted=None, **which) -> Topics:
    """Online LDA over token lists; ``counted`` is what :func:`bags` gives, for several fits on the same rows."""
    vectorizer, rows = counted or bags(docs, **which)
    return Topics(LDA(k=k, maxIter=passes, optimizer="online", seed=seed).fit(rows), vectorizer, rows, k)


def choose_topics(docs: DataFrame, key: str, ks: list[int], passes: int = 10, seed: int = 42, **which) -> tuple[Topics, list[tuple[int, float]]]:
    """The number of topics with the best coherence of the top ten terms. Words are counted once."""
    counted = bags(docs, **which)
    best, table = None, []
    for k in ks:
        fit = fit_topics(docs, k, passes, seed, counted)
        score = window_coherence(docs, key, stored(fit.top_terms(10).select("topic", "term"), "top-terms")).agg(F.avg("coherence")).first()[0]
        table.append((k, float(score)))
        if best is None or score > best[0]:
            best = (score, fit)
    return best[1], table


def cluster_items(items: DataFrame, columns: list[str], k: int, seed: int = 42):
    """k-means on min-max scaled columns. Returns (items with ``cluster``, centres in original units, cost)."""
    scaled = min_max(items, columns)
    rows = VectorAssembler(inputCols=[f"{c}_scaled" for c in columns], outputCol="features").transform(scaled)
    rows = cut_lineage(rows)
    model = KMeans(k=k, seed=seed).fit(rows)
    bounds = items.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns]).first()
    centres = [[bounds[f"lo_{c}"] + x * (bounds[f"hi_{c}"] - bounds[f"lo_{c}"]) for c, x in zip(columns, centre)] for centre in model.clusterCenters()]
    return model.transform(rows).withColumnRenamed("prediction", "cluster"), centres, model.summary.trainingCost


def elbow(items: DataFrame, columns: list[str], ks: range, seed: int = 42) -> DataFrame:
    """Cost of the clustering for each number of clusters."""
    rows = cut_lineage(VectorAssembler(inputCols=[f"{c}_scaled" for c in columns], outputCol="features").transform(min_max(items, columns)))
    table = [(k, float(KMeans(k=k, seed=seed).fit(rows).summary.trainingCost)) for k in ks]
    return items.sparkSession.createDataFrame(table, "k int, inertia double")


def cluster_summary(clustered: DataFrame, count: str, rating: str) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_items"), F.avg(count).alias("avg_reviews"), F.avg(rating).alias("avg_rating"))
