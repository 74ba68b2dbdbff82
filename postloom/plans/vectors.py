"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import scalar
from postloom.operators import clusters, vectors
from postloom.plans.registry import query
from postloom.session import table

_V = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM {_V} a JOIN {_V} b ON a.vec_id = b.vec_id + 1")
def fn_cosine(spark, sf_dir):
    """Each vector with the one before."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return v.join(v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(scalar.cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query(f"""
WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS s FROM {_V} a JOIN {_V} b ON a.vec_id <> b.vec_id), m AS (SELECT vec_id, max(1 - s) AS d FROM p GROUP BY vec_id),
     o AS (SELECT stddev_samp(s) / sqrt(count(*)) AS e, avg(s) AS m FROM p WHERE vec_id < other)
SELECT round(-m, 9) AS mean_diversity, round(e, 9) AS mean_diversity_std_error, round(avg(d), 9) AS mean_max_diversity, round(stddev_samp(d) / sqrt(count(*)), 9) AS mean_max_diversity_std_error FROM m, o GROUP BY m, e
""")
def fn_diversity(spark, sf_dir):
    d = vectors.diversity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return d.select(*(F.round(c, 9).alias(c) for c in d.columns))


@query(f"""
WITH c AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY v) AS class FROM {_V}),
     l AS (SELECT a.vec_id, count(*) AS n FROM {_V} a JOIN {_V} b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.5 GROUP BY a.vec_id)
SELECT vec_id, class, coalesce(n, 0) AS n_links FROM c LEFT JOIN l USING (vec_id)
""")
def fn_similar_classes(spark, sf_dir):
    """Vectors with their class of equal ones and the number of similar ones."""
    return vectors.similar_classes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM {_V} a JOIN {_V} b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.5")
def fn_similar_pairs(spark, sf_dir):
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5).select("a", "b", F.round("cosine", 9).alias("cosine"))


@query()
def agg_community(spark, sf_dir):
    return vectors.communities(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4, 3)


@query()
def agg_kmeans(spark, sf_dir):
    """Eight clusters with their numbers of vectors and mean label, and the silhouette."""
    rows = table(spark, sf_dir, "embeddings")
    points, centres, elbow = clusters.kmeans(rows, "vec_id", "embedding", [8])
    means = clusters.mean_scores(clusters.assigned(points, "vec_id", centres[8]), rows, "vec_id", "label")
    return means.crossJoin(F.broadcast(elbow.select("silhouette")))  # one row


@query()
def agg_kmeans_elbow(spark, sf_dir):
    """Inertia and silhouette of two to ten clusters."""
    return clusters.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", list(range(2, 11)))[2]
