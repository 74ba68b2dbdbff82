"""Votes, precision, recall, correlations, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import evaluation
from postloom.plans.registry import query
from postloom.session import checkpoint, table

_VOTES = "(SELECT event_id % 200 AS item, event_type AS kind, user_id % 5 AS worker, CAST(floor(value) AS INTEGER) % 2 AS score FROM events)"


def _votes(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("item"), F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("worker"), (F.floor("value").cast("int") % 2).alias("score"))


@query(f"""
WITH o AS (SELECT item, kind, worker, min(score) AS score FROM {_VOTES} GROUP BY ALL), c AS (SELECT item, kind, score, count(*) AS n FROM o GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY n DESC, score) AS k, lead(n) OVER (PARTITION BY item, kind ORDER BY n DESC, score) AS second FROM c),
     w AS (SELECT item, kind, score AS winner FROM r WHERE k = 1 AND n > 1 AND (second IS NULL OR n > second))
SELECT item, max(winner) FILTER (kind = 'view') AS view, max(winner) FILTER (kind = 'click') AS click, max(winner) FILTER (kind = 'error') AS error FROM w GROUP BY item
HAVING view IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL
""")
def agg_vote_majority(spark, sf_dir):
    winners = evaluation.majority(_votes(spark, sf_dir), "item", "kind", "worker", "score")
    return evaluation.complete(winners, "item", "kind", ["view", "click", "error"])


#: Expected answers of ten checks (1 yes, 2 no), and the two pairs that catch careless workers.
CHECKS, CHECK_PAIRS = ["1", "1", "2", "2", "2", "2", "2", "2", "1", "2"], ((1, 4), (8, 9))


@query("""
WITH a AS (SELECT user_id, event_id % 10 AS q, min(CASE WHEN value % 2 < 1 THEN '1' ELSE '2' END) AS x FROM events GROUP BY ALL),
     w AS (SELECT user_id, list_transform(range(0, 10), lambda q: coalesce(map_from_entries(list((a.q, a.x)))[q], '')) AS l FROM a GROUP BY user_id),
     k AS (SELECT user_id, array_to_string(l, '_') AS answers, CAST(l[2] = '1' AND l[5] = '2' AS INTEGER) + CAST(l[9] = '1' AND l[10] = '2' AS INTEGER) AS n, l = ['1', '1', '2', '2', '2', '2', '2', '2', '1', '2'] AS good FROM w)
SELECT user_id, answers, CAST(CASE WHEN good THEN 3 ELSE n END AS INTEGER) AS class FROM k WHERE n >= 1
""")
def agg_bot_score(spark, sf_dir):
    """Ten checks of each worker, classed 0 to 3; workers that fail both pairs are dropped."""
    answers = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 10).alias("check"), F.when(F.col("value") % 2 < 1, "1").otherwise("2").alias("answer"))
    return evaluation.attention(answers, "user_id", "check", "answer", CHECKS, CHECK_PAIRS, least=1)


@query("SELECT event_type, vote, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 50 THEN 'no' WHEN value < 150 THEN 'unsure' ELSE 'yes' END AS vote FROM events) GROUP BY ALL")
def agg_crosstab_melt(spark, sf_dir):
    vote = F.when(F.col("value") < 50, "no").when(F.col("value") < 150, "unsure").otherwise("yes")
    wide = table(spark, sf_dir, "events").withColumn("vote", vote).groupBy("event_type").pivot("vote", ["no", "unsure", "yes"]).agg(F.count(F.lit(1)))
    return wide.unpivot("event_type", ["no", "unsure", "yes"], "vote", "n").filter("n > 0")


@query("""
WITH s AS (SELECT d.lang, count(*) AS n, avg(CAST(l.quality AS DOUBLE)) AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang)
SELECT round(sum(p * n) / sum(n), 9) AS base_rate FROM s WHERE p IS NOT NULL
""")
def agg_base_rate_strat(spark, sf_dir):
    """The positive share of each stratum's labelled rows, weighted by the stratum's size."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    strata = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("p")).filter("p IS NOT NULL")
    return strata.agg(F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 9).alias("base_rate"))


_SCORED = "(SELECT l.doc_id, l.toxic, d.n_chars, row_number() OVER (ORDER BY d.n_chars DESC, l.doc_id) AS rank FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(spark, sf_dir):
    from postloom.operators.retrieval import ranked

    return ranked(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "doc_id")


@query(f"SELECT avg(toxic) FILTER (rank <= 20) AS top20, avg(toxic) FILTER (n_chars > 3000) AS above, CASE WHEN count(*) FILTER (rank <= 1) >= 2 THEN avg(toxic) FILTER (rank <= 1) END AS too_few FROM {_SCORED}")
def agg_precision(spark, sf_dir):
    label = F.col("toxic")
    return _scored(spark, sf_dir).agg(*(evaluation.precision(label, c).alias(k) for k, c in (("top20", F.col("rank") <= 20), ("above", F.col("n_chars") > 3000), ("too_few", F.col("rank") <= 1))))


@query(f"SELECT 100.0 * count(*) FILTER (toxic = 1 AND rank <= 100) / count(*) FILTER (toxic = 1) AS recall100, 100.0 * count(*) FILTER (toxic = 1 AND n_chars > 2000) / count(*) FILTER (toxic = 1) AS recall_above FROM {_SCORED}")
def agg_recall(spark, sf_dir):
    return _scored(spark, sf_dir).agg(evaluation.recall(F.col("toxic"), F.col("rank") <= 100).alias("recall100"), evaluation.recall(F.col("toxic"), F.col("n_chars") > 2000).alias("recall_above"))


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY event_type")
def agg_auc_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@query("""
WITH g AS (SELECT quality AS t, CAST(n_chars > 1000 AS INTEGER) AS g FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
     c AS (SELECT count(*) FILTER (t = 1 AND g = 1) AS tp, count(*) FILTER (t = 0 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g = 0) AS fn, count(*) FILTER (t = 0 AND g = 0) AS tn FROM g)
SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy FROM c
""")
def agg_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    c = rows.agg(*evaluation.confusion(F.col("quality"), F.col("guess")))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select("*", F.round(F.try_divide(tp, tp + fp), 9).alias("precision"), F.round(F.try_divide(tp, tp + fn), 9).alias("recall"), F.round(F.try_divide(2.0 * tp, 2 * tp + fp + fn), 9).alias("f1"), F.round((tp + tn) / (tp + fp + fn + tn), 9).alias("accuracy"))


@query("""
WITH r AS (SELECT l_quantity, l_extendedprice, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r
""")
def agg_corr(spark, sf_dir):
    r = evaluation.spearman(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return r.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""
WITH r AS (SELECT user_id, event_type, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
     w AS (SELECT user_id, max(m) FILTER (event_type = 'view') AS view, max(m) FILTER (event_type = 'click') AS click, max(s) FILTER (event_type = 'view') AS view_std, max(s) FILTER (event_type = 'click') AS click_std FROM r GROUP BY user_id)
SELECT user_id, round(view, 6) AS view, round(click, 6) AS click, round(view_std, 6) AS view_std, round(click_std, 6) AS click_std, CAST(dense_rank() OVER (ORDER BY view DESC) AS BIGINT) AS view_rank FROM w WHERE view IS NOT NULL
""")
def agg_run_compare(spark, sf_dir):
    """Mean and standard deviation (null for one event) of each run, and the dense rank of the first."""
    from postloom.operators.retrieval import dense_ranked

    mean, std = F.avg("value"), F.stddev_samp("value")
    events = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')")
    runs = events.groupBy("user_id").pivot("event_type", ["view", "click"]).agg(mean.alias("m"), std.alias("s"))
    wide = dense_ranked(runs.filter("view_m IS NOT NULL"), "view_m")
    values = {"view": "view_m", "click": "click_m", "view_std": "view_s", "click_std": "click_s"}
    return wide.select("user_id", *(F.round(c, 6).alias(k) for k, c in values.items()), F.col("dense_rank").alias("view_rank"))


@query("""
WITH r AS (SELECT o_custkey, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY o_custkey),
     p AS (SELECT sum(sign((x.a - y.a) * (x.b - y.b))) AS s FROM r x JOIN r y ON x.o_custkey < y.o_custkey),
     k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM r)
SELECT round(2 * s / (count(*) * (count(*) - 1.0)), 9) AS tau, round(corr(ra, rb), 6) AS spearman, round(avg(pow(a - b, 2)), 1) AS mse, round(avg(a / b), 9) AS ratio FROM k, p GROUP BY s
""")
def agg_kendall_mse(spark, sf_dir):
    """Two runs of all customers: Kendall's tau, Spearman, mean squared difference and mean ratio."""
    runs = checkpoint(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").cast("double").alias("a"), F.max("o_totalprice").cast("double").alias("b")))
    one, two = evaluation.kendall(runs, "a", "b"), evaluation.spearman(runs, "a", "b")
    both = evaluation.beside(one, two, runs.agg(F.avg(F.try_divide("a", "b")).alias("ratio")))
    return both.select(F.round("tau", 9).alias("tau"), F.round("spearman", 6).alias("spearman"), F.round("mse", 1).alias("mse"), F.round("ratio", 9).alias("ratio"))


@query()
def ml_logreg_platt(spark, sf_dir):
    """A one-feature logistic fit for each language: quality on the logarithm of the length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", F.log1p("n_chars").alias("x"), F.col("quality").cast("double").alias("y"))
    return evaluation.platt(rows, "x", "y", "lang", 12)


@query()
def ml_platt_bootstrap(spark, sf_dir):
    """Intervals of slope and intercept for both labels, over rounds of all positives and as many negatives."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("score")), "doc_id")
    fits = [evaluation.bootstrap_platt(rows, "doc_id", "score", label, 200).withColumn("label", F.lit(label)) for label in ("quality", "toxic")]
    return evaluation.intervals(fits[0].unionByName(fits[1]), ["label"], ["slope", "intercept"])


PATTERNS = ["!!", "###|%%%", r" \| ", r"(\S+ )\1\1"]


def _pattern_scores(spark, sf_dir):
    from postloom.operators import ml

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", "quality")
    return ml.pattern_scores(rows, ml.pattern_model(rows, PATTERNS, "text", "quality"), PATTERNS, "text")


@query()
def ml_pattern_lr(spark, sf_dir):
    return _pattern_scores(spark, sf_dir).select("doc_id", "quality", "score")


@query()
def ml_pattern_report(spark, sf_dir):
    """Precision, recall and F1 of both classes, and the model's exact area under the curve."""
    scored = checkpoint(_pattern_scores(spark, sf_dir).withColumn("guess", (F.col("score") >= 0.5).cast("int")).drop("text"))
    return evaluation.report(scored, "quality", "guess", []).crossJoin(F.broadcast(evaluation.auc(scored, "score", "quality", []).select("auc")))  # one row


@query("""
WITH s AS (SELECT d.lang, m.model, m.score, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id, LATERAL (SELECT unnest(['length', 'words', 'marks']) AS model, unnest([CAST(n_chars AS DOUBLE), CAST(len(string_split(text, ' ')) AS DOUBLE), CAST(-len(regexp_extract_all(text, '[!#%$*&]')) AS DOUBLE)]) AS score) m),
     r AS (SELECT *, rank() OVER (PARTITION BY lang, model ORDER BY score) + (count(*) OVER (PARTITION BY lang, model, score) - 1) / 2.0 AS k FROM s),
     g AS (SELECT lang, model, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, sum(k) FILTER (quality = 1) AS w FROM r GROUP BY ALL)
SELECT lang, model, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((w - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg), 9) END AS auc FROM g
""")
def agg_auc_models(spark, sf_dir):
    """Exact areas under the curve of several scores, by language."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    scores = {"length": F.col("n_chars").cast("double"), "words": F.size(F.split("text", " ")).cast("double"), "marks": -F.size(F.regexp_extract_all("text", F.lit("[!#%$*&]"), F.lit(0))).cast("double")}
    rows = docs.select("lang", "quality", F.explode(F.array(*(F.struct(F.lit(k).alias("model"), c.alias("score")) for k, c in scores.items()))).alias("m")).select("lang", "quality", "m.*")
    return evaluation.auc(rows, "score", "quality", ["lang", "model"]).withColumn("auc", F.round("auc", 9))


@query("""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
     f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM d)
SELECT round(slope, 4) AS slope, round(intercept, 2) AS intercept, round(r2, 6) AS r2, round(sqrt(avg(pow(y - slope * x - intercept, 2))), 2) AS rmse FROM d, f GROUP BY slope, intercept, r2
""")
def ml_ols(spark, sf_dir):
    from postloom.operators import ml

    f = ml.least_squares(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return f.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"))


#: A monthly series for each quarter of account balances and those above it: the mean price, that of the month before, and two shares.
_SERIES = """
u AS (SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 2750) AS BIGINT) AS q FROM customer),
s AS (SELECT g, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS price, avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS urgent, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS filled
      FROM orders JOIN u ON o_custkey = c_custkey JOIN range(0, 4) l(g) ON q >= g GROUP BY ALL),
p AS (SELECT *, lag(price) OVER (PARTITION BY g ORDER BY month) AS price_lag FROM s)
"""
#: Models of the series: without and with the panel's columns.
SERIES_MODELS = {"AR(1)": ["price_lag"], "urgent": ["urgent"], "AR(1)+panel": ["price_lag", "urgent", "filled"]}


def _series(spark, sf_dir):
    from postloom.operators import regression

    quarter = F.floor((F.col("c_acctbal") + 1000) / 2750)
    users = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.when(quarter >= 0, F.sequence(F.lit(0).cast("long"), F.least(quarter, F.lit(3).cast("long"))))).alias("g"))
    orders = table(spark, sf_dir, "orders").join(users, F.col("o_custkey") == F.col("c_custkey"))
    means = [F.avg(e).alias(n) for n, e in (("price", "o_totalprice"), ("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("double")), ("filled", (F.col("o_orderstatus") == "F").cast("double")))]
    series = orders.groupBy("g", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(*means)
    return regression.lagged(series, ["g"], "month", "price")


def _fit_sql(name: str, xs: list[str], rows: str) -> str:
    """Common tables of a fit by its normal equations, solved by determinants: sums m, coefficients b0, b1, and on."""
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    n = len(xs)

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'-' if k % 2 else '+'} {m[0][k]} * {det([r[:k] + r[k + 1 :] for r in m[1:]])}" for k in range(len(m))) + ")"

    within = [[s(i, j) for j in range(1, n + 1)] for i in range(1, n + 1)]
    swapped = lambda k: [[s(0, i) if j == k else s(i, j) for j in range(1, n + 1)] for i in range(1, n + 1)]
    columns = ["price", *xs]
    sums = ", ".join([f"avg({c}) AS m{i}" for i, c in enumerate(columns)] + [f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j])
    slopes = ", ".join(f"{det(swapped(k))} / {det(within)} AS b{k}" for k in range(1, n + 1))
    const = "m0 " + " ".join(f"- b{k} * m{k}" for k in range(1, n + 1))
    explained = " + ".join(f"b{k} * s0{k}" for k in range(1, n + 1))
    return f"m_{name} AS (SELECT g, count(*) AS n, {sums} FROM {rows} GROUP BY g), c_{name} AS (SELECT *, {slopes} FROM m_{name}), f_{name} AS (SELECT *, {const} AS b0, ({explained}) / s00 AS r2, sqrt(greatest(s00 - ({explained}), 0)) AS rmse FROM c_{name})"


def _panel_sql() -> str:
    known = "k AS (SELECT * FROM p WHERE price_lag IS NOT NULL)"
    fits = ", ".join(_fit_sql(f"a{i}", xs, "k") for i, xs in enumerate(SERIES_MODELS.values()))
    parts = [f"SELECT g, '{name}' AS model, '{term}' AS term, round(b{k}, 4) AS coefficient, n, round(r2, 8) AS r2, round(rmse, 4) AS rmse FROM f_a{i}" for i, (name, xs) in enumerate(SERIES_MODELS.items()) for k, term in enumerate(["const", *xs])]
    return f"WITH {_SERIES}, {known}, {fits} {' UNION ALL '.join(parts)}"


def _forecast_sql() -> str:
    split = "TIMESTAMP '1996-12-01'"
    known = f"k AS (SELECT * FROM p WHERE price_lag IS NOT NULL), train AS (SELECT * FROM k WHERE month <= {split}), test AS (SELECT * FROM k WHERE month >= {split})"
    fits = ", ".join(_fit_sql(f"a{i}", xs, "train") for i, xs in enumerate(SERIES_MODELS.values()))
    parts = []
    for i, (name, xs) in enumerate(SERIES_MODELS.items()):
        guess = "b0 " + " ".join(f"+ b{k} * {x}" for k, x in enumerate(xs, 1))
        parts.append(f"SELECT g, '{name}' AS model, n AS n_train, count(*) AS n_test, round(rmse, 4) AS rmse_train, round(sqrt(avg(pow(price - ({guess}), 2))), 4) AS rmse_test FROM f_a{i} JOIN test USING (g) GROUP BY g, n, rmse")
    return f"WITH {_SERIES}, {known}, {fits} {' UNION ALL '.join(parts)}"


@query(_panel_sql())
def ml_ols_panel(spark, sf_dir):
    """Fits with and without the lagged target and the panel's shares, in each nested group of balances."""
    from postloom.operators import regression

    fits = regression.least_squares(_series(spark, sf_dir), "price", SERIES_MODELS, ["g"])
    return fits.select("g", "model", "term", F.round("coefficient", 4).alias("coefficient"), "n", F.round("r2", 8).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query(_forecast_sql())
def ml_ols_forecast(spark, sf_dir):
    """Errors of the models inside the months up to a split, and outside, from the split on."""
    from postloom.operators import regression

    split = F.lit("1996-12-01").cast("timestamp_ntz")
    out = regression.forecast(_series(spark, sf_dir), "price", SERIES_MODELS, ["g"], F.col("month") <= split, F.col("month") >= split)
    return out.select("g", "model", "n_train", "n_test", F.round("rmse_train", 4).alias("rmse_train"), F.round("rmse_test", 4).alias("rmse_test"))


@query()
def ml_logit_features(spark, sf_dir):
    """Whether a customer ever had an urgent order, by balance and activity, in each market segment."""
    from postloom.operators import regression

    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"), F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    users = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return regression.logit(users, "urgent", ["c_acctbal", "n_orders", "mean_price"], ["c_mktsegment"])


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents")
def ml_pipeline_tokenizer(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RegexTokenizer

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W")]).fit(docs).transform(docs).select("doc_id", F.size("tokens").alias("n_tokens"))


@query("SELECT doc_id, length(text) / (length(text) + 1000.0) AS lost, 1000.0 / (length(text) + 1000.0) AS hired FROM documents")
def ml_model_inference(spark, sf_dir):
    """Scores of several classes in one pass; the model here is a stand-in of closed form, loaded once a task."""
    from postloom.operators import ml

    def load():
        import pandas as pd

        def model(texts: pd.Series) -> pd.DataFrame:
            n = texts.str.len().astype(float)
            return pd.DataFrame({"lost": n / (n + 1000.0), "hired": 1000.0 / (n + 1000.0)})

        return model

    return ml.score_batches(table(spark, sf_dir, "documents"), "doc_id", "text", load, ["lost", "hired"])


@query()
def ml_training(spark, sf_dir):
    from postloom.operators import ml

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", "toxic")
    _, area = ml.train_classifier(rows, "text", "toxic", "doc_id", strengths=(0.1, 0.01))
    return spark.createDataFrame([(area,)], "auroc double")


@query("SELECT c_custkey AS user_id, CAST(length(c_name) % 2 AS DOUBLE) AS is_org, 1.0 / CAST(1 + length(c_mktsegment) AS DOUBLE) AS age_score FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM labels)")
def ml_demographics(spark, sf_dir):
    """Profiles without a prediction yet, scored in batches by a stand-in model from name and description."""
    import pandas as pd

    from postloom.operators import ml
    from postloom.sources.readers import pending

    def load():
        def model(texts: pd.Series) -> pd.DataFrame:
            name, segment = texts.str.split("|").str[0].str.len(), texts.str.split("|").str[1].str.len()
            return pd.DataFrame({"is_org": (name % 2).astype(float), "age_score": 1.0 / (1 + segment)})

        return model

    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat_ws("|", "c_name", "c_mktsegment").alias("text"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"))
    return ml.score_batches(pending(profiles, done, "user_id"), "user_id", "text", load, ["is_org", "age_score"])
