"""Counts, panels and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions import text
from postloom.operators import lift, panels
from postloom.plans.registry import query
from postloom.session import table

KEYWORDS = ["thand", "euxan", "schein"]


def _user_days(spark, sf_dir):
    """A row for each user and day: whether there was a purchase, an error; activity and first time."""
    flags = [(F.col("event_type") == k).cast("int").alias(k) for k in ("purchase", "error")]
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "value", *flags)


_DAYS = "(SELECT user_id, CAST(ts AS DATE) AS day, ts, value, CAST(event_type = 'purchase' AS INTEGER) AS purchase, CAST(event_type = 'error' AS INTEGER) AS error FROM events)"


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types FROM events")
def agg_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_type").alias("n_types"))


@query("SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1 ORDER BY 1")
def agg_users_by_month(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count_distinct("user_id").alias("n_users")).orderBy("day")


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type ORDER BY n_users DESC, event_type")
def agg_users_by_location(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users")).orderBy(F.desc("n_users"), "event_type")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def agg_tweets_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(10)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(DISTINCT o_custkey) AS n_users FROM orders GROUP BY 1, 2")
def agg_users_year_loc(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_users"))


@query(f"SELECT day, CAST(sum(purchase) AS BIGINT) AS purchase, CAST(sum(error) AS BIGINT) AS error, count(DISTINCT user_id) AS n_users FROM {_DAYS} GROUP BY day")
def agg_mention_panel(spark, sf_dir):
    return panels.panel(_user_days(spark, sf_dir), ["day"], ["purchase", "error"], "user_id")


@query(f"SELECT user_id, max(purchase) AS purchase, max(error) AS error, min(ts) AS ts FROM {_DAYS} GROUP BY user_id")
def agg_user_max_flags(spark, sf_dir):
    return panels.user_flags(_user_days(spark, sf_dir), ["user_id"], ["purchase", "error"], "ts")


@query(f"SELECT user_id, day, max(purchase) AS purchase, max(error) AS error FROM {_DAYS} GROUP BY user_id, day")
def agg_user_month_max(spark, sf_dir):
    return panels.user_flags(_user_days(spark, sf_dir), ["user_id", "day"], ["purchase", "error"])


@query(f"""
WITH u AS (SELECT user_id, day, max(purchase) AS purchase, count(*) AS activity FROM {_DAYS} GROUP BY user_id, day)
SELECT day, CAST(CASE WHEN activity >= 5 THEN 2 WHEN activity >= 3 THEN 1 ELSE 0 END AS INTEGER) AS q_activity, CAST(sum(purchase) AS BIGINT) AS purchase, count(*) AS n_users FROM u GROUP BY ALL
""")
def agg_panel_sum_count(spark, sf_dir):
    users = _user_days(spark, sf_dir).groupBy("user_id", "day").agg(F.max("purchase").alias("purchase"), F.count("*").alias("activity"))
    return panels.panel(users.withColumn("q_activity", panels.bucket_of(F.col("activity"), [3, 5])), ["day", "q_activity"], ["purchase"])


@query("SELECT round(sum(value), 4) AS value, CAST(sum(user_id) AS BIGINT) AS users FROM events")
def agg_global_sum(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.sum("value"), 4).alias("value"), F.sum("user_id").alias("users"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word HAVING count(*) >= 20")
def agg_word_count(spark, sf_dir):
    return lift.word_counts(table(spark, sf_dir, "documents")).filter("n >= 20")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE contains(word, '#') GROUP BY word")
def agg_hashtags(spark, sf_dir):
    return lift.word_counts(table(spark, sf_dir, "documents")).filter(F.col("word").contains("#"))


@query("""
WITH t AS (SELECT doc_id, lower(text) AS text FROM documents), w AS (SELECT text, unnest(string_split(text, ' ')) AS word FROM t),
     c AS (SELECT word, count(*) AS n_all FROM w GROUP BY word), k(keyword) AS (VALUES ('thand'), ('euxan'), ('schein')),
     n AS (SELECT keyword, word, count(*) AS n FROM w JOIN k ON contains(w.text, k.keyword) GROUP BY ALL)
SELECT keyword, n.word, n, n_all, n / CAST(n_all AS DOUBLE) AS pct FROM n JOIN c ON n.word = c.word QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY n DESC, n.word) <= 50
""")
def agg_cooccurrence(spark, sf_dir):
    return lift.cooccurrence(table(spark, sf_dir, "documents"), KEYWORDS, top=50)


@query("SELECT keyword, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n FROM (SELECT k.keyword, w.word, count(*) AS n FROM (SELECT lower(text) AS text, unnest(string_split(lower(text), ' ')) AS word FROM documents) w JOIN (VALUES ('thand'), ('schein')) k(keyword) ON contains(w.text, k.keyword) GROUP BY ALL) GROUP BY keyword")
def kw_cooccurrence(spark, sf_dir):
    """How many words, and occurrences of words, stand in texts with each keyword."""
    found = lift.cooccurrence(table(spark, sf_dir, "documents"), ["thand", "schein"])
    return found.groupBy("keyword").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


@query("SELECT avg(CAST(contains(text, 'the and') AS INTEGER)) AS the_and, avg(CAST(contains(text, 'que de') AS INTEGER)) AS que_de FROM documents")
def agg_mean_base_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(*(F.avg(c).alias(k) for c, k in zip(text.contains_flags(F.col("text"), ["the and", "que de"]), ("the_and", "que_de"), strict=True)))


@query("SELECT o_custkey, q, count(*) AS n FROM (SELECT o_custkey, CAST(CASE WHEN o_totalprice >= 400000 THEN 3 WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS INTEGER) AS q FROM orders) GROUP BY ALL")
def ml_bucketizer(spark, sf_dir):
    q = panels.bucket_of(F.col("o_totalprice"), [100000.0, 200000.0, 400000.0])
    return table(spark, sf_dir, "orders").groupBy("o_custkey", q.alias("q")).agg(F.count("*").alias("n"))


@query("SELECT event_type, quantile_disc(value, [0.0, 0.1, 0.5, 0.9]) AS quantiles FROM events GROUP BY event_type")
def agg_quantile_array(spark, sf_dir):
    return panels.quantile_arrays(table(spark, sf_dir, "events"), ["event_type"], "value", [0.0, 0.1, 0.5, 0.9])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median, count(value) AS n FROM events GROUP BY event_type")
def agg_describe(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.count(v).alias("n"))


@query(f"SELECT day, CAST(sum(purchase) AS BIGINT) AS purchase, count(DISTINCT user_id) AS n_users, sum(purchase) / CAST(count(DISTINCT user_id) AS DOUBLE) AS purchase_rate FROM {_DAYS} GROUP BY day")
def agg_ratio_panel(spark, sf_dir):
    return panels.rates(panels.panel(_user_days(spark, sf_dir), ["day"], ["purchase"], "user_id"), ["purchase"], "n_users")


@query(f"""
WITH u AS (SELECT user_id % 7 AS geo_id, day, user_id, max(purchase) AS purchase FROM {_DAYS} GROUP BY ALL),
     c AS (SELECT geo_id, day, count(*) AS n, sum(purchase) AS purchase FROM u GROUP BY ALL HAVING count(*) >= 10),
     w AS (SELECT c.*, (1000.0 + 100 * geo_id) / n AS w FROM c)
SELECT day, round(sum(purchase * w) / sum(n * w), 9) AS purchase FROM w GROUP BY day
""")
def agg_poststratify(spark, sf_dir):
    users = panels.user_flags(_user_days(spark, sf_dir).withColumn("geo_id", F.col("user_id") % 7), ["geo_id", "day", "user_id"], ["purchase"])
    population = spark.range(7).select(F.col("id").alias("geo_id"), (1000.0 + 100 * F.col("id")).alias("pop"))
    return panels.poststratify(users, population, ["geo_id"], ["day"], ["purchase"], 10).withColumn("purchase", F.round("purchase", 9))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY o_orderpriority")
def agg_rural_complement(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 5")
def agg_topk_groups(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(5)


@query("SELECT event_type, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type FROM events) GROUP BY event_type")
def agg_value_share(spark, sf_dir):
    """Shares with nulls kept as a value."""
    values = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("event_type"))
    counts = values.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a value


@query("""
WITH g AS (SELECT event_type, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT lang AS event_type, string_split(lower(text), ' ') AS w FROM documents))
SELECT event_type AS cluster, gram, count(*) AS n FROM g GROUP BY event_type, gram QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, gram) <= 20
""")
def agg_top_ngrams(spark, sf_dir):
    counts = lift.ngram_counts(table(spark, sf_dir, "documents"), 2, by=F.col("lang")).withColumnRenamed("by", "cluster")
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "gram"))).filter("k <= 20").drop("k")


@query(f"""
WITH u AS (SELECT user_id, day, max(purchase) AS purchase, count(*) AS activity, user_id % 4 AS q_age FROM {_DAYS} GROUP BY user_id, day),
     q AS (SELECT *, CAST(least(activity, 3) AS BIGINT) AS q_act FROM u), l(a) AS (VALUES (0), (1), (2), (3))
SELECT l1.a AS q1, l2.a AS q2, day, count(*) AS n, CAST(sum(purchase) AS BIGINT) AS purchase FROM q JOIN l l1 ON q_age >= l1.a JOIN l l2 ON q_act >= l2.a GROUP BY ALL
""")
def agg_nested_quantile_groups(spark, sf_dir):
    users = _user_days(spark, sf_dir).groupBy("user_id", "day").agg(F.max("purchase").alias("purchase"), F.count("*").alias("activity"))
    users = users.withColumns({"q_age": F.col("user_id") % 4, "q_act": F.least("activity", F.lit(3))})
    return panels.nested_groups(users, "q_age", "q_act", [0, 1, 2, 3], ["day"], "purchase")


@query("SELECT r_regionkey, n_nationkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_regionkey, n_nationkey)")
def agg_rollup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def agg_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def agg_grouping_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupingSets([[docs.lang], [docs.source], []], docs.lang, docs.source).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS INTEGER) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def win_row_number_part(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")))


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS activity, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
SELECT *, lag(activity) OVER (PARTITION BY o_custkey ORDER BY year) AS activity_lag, lag(total) OVER (PARTITION BY o_custkey ORDER BY year) AS total_lag FROM y
""")
def win_lag_user(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("activity"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return panels.lagged(years, "o_custkey", "year", ["activity", "total"])


@query("WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, lag(n) OVER (ORDER BY month) AS previous FROM m")
def win_shift_ts(spark, sf_dir):
    """The value of the month before; the window runs over one row a month."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))
    return months.withColumn("previous", F.lag("n").over(Window.orderBy("month")))


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d")
def win_rolling(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("week", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(-6, 0)))
