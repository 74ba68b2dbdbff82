"""Projections, filters and text predicates over documents and events."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from postloom.functions import scalar, social, text
from postloom.plans.registry import query
from postloom.session import table

LABELS = {"loss": ["idiot", "trash", "loser"], "search": ["with the", "von der"], "hire": ["the and", "die"], "offer": ["license", "rights reserved"]}
PHRASES = ["the and", "of the", "die", "que de", "license"]
SYMPTOMS = {"fever": "fever|heat|erhe", "cough": "cough|thou|ouea", "pain": "pain|ache|inor"}


def _flag_sql(column: str, phrases: list[str]) -> str:
    return f"CAST(regexp_matches(lower({column}), '{text.alternation(phrases)}') AS INTEGER)"


_LABEL_SQL = ", ".join(f"{_flag_sql('text', v)} AS {k}" for k, v in LABELS.items())


@query(f"""
WITH d AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE lang = 'en' GROUP BY text),
     f AS (SELECT e.source, {_LABEL_SQL.replace("text", "d.text")} FROM d JOIN documents e ON d.doc_id = e.doc_id)
SELECT source, count(*) AS n_documents, {", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in LABELS)} FROM f GROUP BY source
""")
def flagship_keyword_panel(spark, sf_dir):
    """English documents, one for each text, flagged by label patterns and counted by source."""
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    first = docs.groupBy("text").agg(F.min_by("source", "doc_id").alias("source"))
    flagged = first.select("source", *(text.regex_flag(F.col("text"), v).alias(k) for k, v in LABELS.items()))
    return flagged.groupBy("source").agg(F.count("*").alias("n_documents"), *(F.sum(k).alias(k) for k in LABELS))


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k FROM events")
def prj_flatten(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k INT"))
    return parsed.select("event_id", "user_id", F.col("p.k").alias("props_k"))


@query("SELECT doc_id, CASE WHEN coalesce(doc_id % 3 = 0 AND doc_id % 10 <> 0, false) THEN text ELSE substr(text, 1, 140) END AS post FROM documents")
def prj_coalesce_text(spark, sf_dir):
    cut = F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") % 3 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", text.coalesce_text(F.substring("text", 1, 140), F.col("text"), cut).alias("post"))


@query("SELECT event_id, date_trunc('second', ts) AS created_at FROM events")
def prj_parse_ts(spark, sf_dir):
    """Post times such as ``Mon Jan 01 00:00:07 +0000 2024``; the day's name is skipped, junk gives null."""
    posts = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")).alias("posted"))
    return posts.select("event_id", F.try_to_timestamp(F.substring("posted", 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")).cast("timestamp_ntz").alias("created_at"))


@query("SELECT event_id, date_trunc('second', ts) AS created_at FROM events WHERE year(ts) = 2024")
def prj_parse_ts_plain(spark, sf_dir):
    posts = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("posted"))
    parsed = posts.select("event_id", F.try_to_timestamp("posted", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("created_at"))
    return parsed.filter(F.year("created_at") == 2024)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS lon, CASE WHEN vec_id % 3 = 2 THEN CAST(embedding[2] AS DOUBLE) END AS lat FROM embeddings")
def prj_lonlat(spark, sf_dir):
    """Coordinates that may be null, or have one element only."""
    coordinates = F.when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 1)).when(F.col("vec_id") % 3 == 2, F.slice("embedding", 1, 2))
    return table(spark, sf_dir, "embeddings").select("vec_id", coordinates.alias("c")).select("vec_id", F.get("c", F.lit(0)).cast("double").alias("lon"), F.get("c", F.lit(1)).cast("double").alias("lat"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(month(o_orderdate) AS VARCHAR) AS month FROM orders")
def prj_year_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"), F.month("o_orderdate").cast("string").alias("month"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders")
def prj_ymd(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def prj_month_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lower(text) AS text FROM documents")
def prj_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))


@query('SELECT doc_id, CAST(contains(text, \'of the?\') AS INTEGER) AS "of_the_", CAST(contains(text, \'que de\') AS INTEGER) AS "que_de" FROM documents')
def prj_sanitise_colname(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *text.contains_flags(F.col("text"), ["of the?", "que de"]))


@query("SELECT doc_id AS tweet_id, lang, 1 AS one, n_chars * 2 AS twice FROM documents")
def prj_drop_rename_literal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").drop("text", "source").withColumnRenamed("doc_id", "tweet_id").withColumn("one", F.lit(1))
    return docs.selectExpr("tweet_id", "lang", "one", "n_chars * 2 AS twice")


@query("SELECT lang, source, CAST(dense_rank() OVER (ORDER BY first_id) - 1 AS INTEGER) AS geo_id FROM (SELECT lang, source, min(doc_id) AS first_id FROM documents GROUP BY lang, source)")
def prj_geo_id(spark, sf_dir):
    """A dense number for each place, in order of first appearance."""
    from postloom.operators.retrieval import dense_ranked

    first = table(spark, sf_dir, "documents").groupBy("lang", "source").agg((-F.min("doc_id")).alias("first"))
    return dense_ranked(first, "first").select("lang", "source", (F.col("dense_rank") - 1).cast("int").alias("geo_id"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS code FROM events")
def prj_code_maps(spark, sf_dir):
    codes = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    return table(spark, sf_dir, "events").select("event_id", codes.alias("code"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS vote FROM orders")
def prj_vote_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("vote"))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN (event_id * 7919) % 4 + 1 ELSE length(event_type) END AS INTEGER) AS code FROM events")
def prj_random_unsure(spark, sf_dir):
    """Unsure codes are replaced by a valid one drawn from the id, so that a rerun draws the same."""
    drawn = (F.col("event_id") * 7919) % 4 + 1
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", drawn).otherwise(F.length("event_type")).cast("int").alias("code"))


@query("SELECT d.doc_id, CAST(l.quality IS NOT NULL AS INTEGER) AS has_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prj_has_description(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("quality").isNotNull().cast("int").alias("has_label"))


@query("SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'LOC' WHEN source IN ('src2', 'src3') THEN 'ORG' ELSE 'MISC' END AS tag, count(*) AS n FROM documents GROUP BY ALL")
def prj_ner_tag_map(spark, sf_dir):
    tag = F.when(F.col("source").isin("src0", "src1"), "LOC").when(F.col("source").isin("src2", "src3"), "ORG").otherwise("MISC")
    return table(spark, sf_dir, "documents").groupBy("source", tag.alias("tag")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'ORG' WHEN length(text) % 2 = 0 THEN 'LOC' WHEN turn % 2 = 1 THEN 'JOB' ELSE 'MISC' END AS label,
       lag(conv_id) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS begins
FROM conversations
""")
def prj_ner_long(spark, sf_dir):
    """Indicator columns to one label, the first that is true; a sentence begins where the id changes."""
    from pyspark.sql.window import Window

    label = F.when(F.col("role") == "user", "ORG").when(F.length("text") % 2 == 0, "LOC").when(F.col("turn") % 2 == 1, "JOB").otherwise("MISC")
    begins = F.lag("conv_id").over(Window.partitionBy("conv_id").orderBy("turn")).isNull()
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("label"), begins.alias("begins"))


@query("SELECT source, CASE WHEN count(*) < 40 THEN 1.0 ELSE 40 / CAST(count(*) AS DOUBLE) END AS fraction FROM documents GROUP BY source")
def prj_when(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when(n < 40, 1.0).otherwise(40 / n).alias("fraction"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def prj_temp_view_sql(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("posts_of_prj_temp_view_sql")
    return spark.sql("SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM posts_of_prj_temp_view_sql GROUP BY lang")


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def flt_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id", "source")


@query("SELECT doc_id, contains(text, 'RT @') AS has_rt_at, contains(text, 'RT ') AS has_rt, starts_with(lower(text), 'rt') AS begins_rt FROM documents WHERE NOT contains(text, 'OR!!') AND NOT starts_with(lower(text), 'the')")
def flt_not_retweet(spark, sf_dir):
    """The spellings of a forward that posts are filtered by, on marks that the documents have."""
    docs = table(spark, sf_dir, "documents").filter(~F.col("text").contains("OR!!") & ~F.lower("text").startswith("the"))
    return docs.select("doc_id", F.col("text").contains("RT @").alias("has_rt_at"), F.col("text").contains("RT ").alias("has_rt"), F.lower("text").startswith("rt").alias("begins_rt"))


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def flt_date_range(spark, sf_dir):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-12 00:00:00"))
    return table(spark, sf_dir, "events").filter(F.col("ts").between(low, high)).select("event_id", "ts")


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL")
def flt_not_null(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").filter("toxic IS NOT NULL").select("doc_id", "toxic")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def flt_na_drop(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic").na.drop()


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id NOT IN (1, 2, 3)")
def flt_isin_notin(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click") & ~F.col("user_id").isin(1, 2, 3)).select("event_id")


@query("WITH c(event_type, cutoff) AS (VALUES ('view', 100.0), ('click', 50.0), ('error', 400.0)) SELECT e.event_id, e.event_type, e.value FROM events e JOIN c ON e.event_type = c.event_type WHERE e.value >= c.cutoff")
def flt_threshold(spark, sf_dir):
    cutoffs = spark.createDataFrame([("view", 100.0), ("click", 50.0), ("error", 400.0)], "event_type string, cutoff double")
    return table(spark, sf_dir, "events").join(cutoffs, "event_type").filter("value >= cutoff").select("event_id", "event_type", "value")


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE c.c_nationkey = s.s_nationkey")
def flt_country_match(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return both.filter("c_nationkey = s_nationkey").select("c_custkey", "s_suppkey")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 25")
def flt_min_support(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 25")


@query("""
SELECT DISTINCT place FROM (SELECT trim(regexp_replace(lower(c_name), '[[:punct:]]', '', 'g')) AS place, c_mktsegment, c_name FROM customer)
WHERE place NOT IN ('customer000000001', 'customer000000002') AND NOT contains(c_mktsegment, 'BUILDING') AND NOT regexp_matches(c_name, '^[[:punct:]]+$') AND regexp_matches(place, '[0-9]') AND place <> ''
""")
def flt_bad_location(spark, sf_dir):
    """Normalised places outside a stop list, without a platform's name, not only marks, not blank."""
    places = table(spark, sf_dir, "customer").withColumn("place", F.trim(F.regexp_replace(F.lower("c_name"), r"\p{Punct}", "")))
    stops = spark.createDataFrame([("customer000000001",), ("customer000000002",)], "place string")
    good = places.filter(~F.col("c_mktsegment").contains("BUILDING") & ~F.col("c_name").rlike(r"^\p{Punct}+$") & F.col("place").rlike(r"\d") & (F.col("place") != ""))
    return good.join(stops, "place", "left_anti").select("place").distinct()


@query("SELECT page_id, regexp_extract(url, 'https?://[^/\\s]+', 0) AS link FROM pages")
def flt_regex_down(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"https?://[^/\s]+", 0).alias("link"))


@query("SELECT doc_id, " + ", ".join(f"CAST(contains(text, '{p}') AS INTEGER) AS {text.column_name(p)}" for p in PHRASES) + " FROM documents")
def kw_contains_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *text.contains_flags(F.col("text"), PHRASES))


@query(f"SELECT doc_id, {_LABEL_SQL} FROM documents")
def kw_regex_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(text.regex_flag(F.col("text"), v).alias(k) for k, v in LABELS.items()))


@query(f"SELECT doc_id, CAST({' + '.join(LABELS)} > 0 AS INTEGER) AS any_label FROM (SELECT doc_id, {_LABEL_SQL} FROM documents)")
def kw_any(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.any_flag([text.regex_flag(F.col("text"), v) for v in LABELS.values()]).alias("any_label"))


@query(r"SELECT doc_id, contains(text, 'the') AS one, regexp_matches(text, 'den|que') AS alternatives, regexp_matches(text, 'the[.\w\s\d]*and') AS two, regexp_matches(text, 'of[.\w\s\d]*the[.\w\s\d]*to') AS three FROM documents")
def kw_ngram_gap(spark, sf_dir):
    c, grams = F.col("text"), {"one": ["the"], "alternatives": ["den|que"], "two": ["the", "and"], "three": ["of", "the", "to"]}
    return table(spark, sf_dir, "documents").select("doc_id", *(text.ngram_gap(c, v).alias(k) for k, v in grams.items()))


@query(r"SELECT doc_id, (regexp_matches(text, '^[A-Z]+ing') OR regexp_matches(text, 'token = ') OR contains(text, 'license')) AS hit FROM documents")
def kw_regex_or_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.any_of(F.col("text"), ["^[A-Z]+ing", "token = "], ["license"]).alias("hit"))


@query(r"SELECT doc_id, CAST(regexp_matches(text, '\bthe\b.*\bof\b') OR contains(text, 'von der') AS INTEGER) AS seed FROM documents")
def kw_seedlist_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.any_of(F.col("text"), [r"\bthe\b.*\bof\b"], ["von der"]).cast("int").alias("seed"))


@query("SELECT d.doc_id, CAST(count(b.item_id) > 0 AS INTEGER) AS has_sentence FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def kw_sentence_flag(spark, sf_dir):
    """Any known sentence is a substring: texts and sentences meet by inner words, then are compared whole."""
    from postloom.operators.match import contains_any

    docs, sentences = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contains_any(docs, sentences.select(F.col("text").alias("sentence"))).select("doc_id", F.col("found").cast("int").alias("has_sentence"))


@query(r"""
WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}{14,}')) AS phrase FROM benchmark)
SELECT d.doc_id, count(p.phrase) > 0 AS found FROM documents d LEFT JOIN p ON contains(d.text, p.phrase) GROUP BY d.doc_id
""")
def kw_phrase_table(spark, sf_dir):
    """Whether any long word of the benchmark is part of a text: a table of phrases of any length, as automata."""
    from postloom.operators.match import phrase_flags

    phrases = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{14,}"), F.lit(0))).alias("phrase"))
    return phrase_flags(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", phrases, "phrase").select("doc_id", "found")


@query(r"""
SELECT avg(CAST(regexp_matches(text, 'ing\b') AS INTEGER)) AS share_class, avg(CAST(regexp_matches(text, 'ing\b|tion\b') AS INTEGER)) AS share_all
FROM (SELECT text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200)
""")
def kw_share(spark, sf_dir):
    top = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    return top.agg(F.avg(F.col("text").rlike(r"ing\b").cast("int")).alias("share_class"), F.avg(F.col("text").rlike(r"ing\b|tion\b").cast("int")).alias("share_all"))


@query(r"SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^a-z0-9_]'), ['the', 'of', 'and'])")
def kw_lookahead(spark, sf_dir):
    """All tokens, in any order, as whole words."""
    return table(spark, sf_dir, "documents").filter(text.has_tokens(text.tokens_nonword(F.col("text")), ["the", "of", "and"])).select("doc_id")


@query("SELECT doc_id, list_has_all(string_split(text, ' '), ['the', 'is']) AS has_motif FROM documents")
def kw_token_subset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_tokens(text.tokens_space(F.col("text")), ["the", "is"]).alias("has_motif"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bthe\b.*\bof\b', 'i')")
def kw_ordered_regex(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(text.ordered_pattern(["the", "of"]))).select("doc_id")


@query(r"SELECT doc_id, [CAST(regexp_matches(text, '!!') AS INTEGER), CAST(regexp_matches(text, '###|%%%') AS INTEGER), CAST(regexp_matches(text, ' \| ') AS INTEGER), CAST(regexp_matches(text, '[0-9]{4}') AS INTEGER)] AS features FROM documents")
def kw_pattern_features(spark, sf_dir):
    patterns = ["!!", "###|%%%", r" \| ", "[0-9]{4}"]
    return table(spark, sf_dir, "documents").select("doc_id", F.array(*(F.col("text").rlike(p).cast("int") for p in patterns)).alias("features"))


@query("SELECT *, CAST(fever + cough + pain AS INTEGER) AS nb_symptoms, CAST(fever + cough + pain >= 1 AS INTEGER) AS contains_symptom FROM (SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(text, '{v}') AS INTEGER) AS {k}" for k, v in SYMPTOMS.items()) + " FROM documents)")
def kw_symptom(spark, sf_dir):
    flags = table(spark, sf_dir, "documents").select("doc_id", *(F.col("text").rlike(v).cast("int").alias(k) for k, v in SYMPTOMS.items()))
    total = sum((F.col(k) for k in SYMPTOMS), F.lit(0))
    return flags.withColumns({"nb_symptoms": total, "contains_symptom": (total >= 1).cast("int")})


@query(r"SELECT doc_id, regexp_matches(lower(text), 'license|rights') AS legal, regexp_matches(lower(text), 'token|key') AS secret, regexp_matches(lower(text), 'stay.{0,3}home') AS home FROM documents")
def kw_topic(spark, sf_dir):
    topics = {"legal": "license|rights", "secret": "token|key", "home": "stay.{0,3}home"}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.lower("text").rlike(v).alias(k) for k, v in topics.items()))


@query(r"SELECT doc_id, regexp_matches(lower(text), '^the | the |^you | you ') AS has_pronoun FROM documents")
def kw_pronoun(spark, sf_dir):
    pattern = "|".join(f"^{p} | {p} " for p in ("the", "you"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").rlike(pattern).alias("has_pronoun"))


@query(r"""
SELECT doc_id, (regexp_matches(lower(text), '^the | the ') OR regexp_matches(lower(text), '^(erhe|thou|inor)')) AND NOT contains(text, '###') AND regexp_matches(text, 'erhe|thou|inor') AS reports
FROM documents
""")
def kw_symptom_rule(spark, sf_dir):
    """(A pronoun, or a symptom at the start) and no tag and a symptom."""
    c, names = F.col("text"), "erhe|thou|inor"
    rule = (F.lower(c).rlike("^the | the ") | F.lower(c).rlike(f"^({names})")) & ~c.contains("###") & c.rlike(names)
    return table(spark, sf_dir, "documents").select("doc_id", rule.alias("reports"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url || ' by @user_1', '@\w+', '@mention', 'g'), 'https?://\S+', '<url>', 'g') AS text FROM pages")
def fn_strip_mentions_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.mask_mentions_urls(F.concat("url", F.lit(" by @user_1"))).alias("text"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents WHERE lang IN ('fr', 'es')")
def fn_unaccent_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("lang").isin("fr", "es")).select("doc_id", text.unaccent(F.col("text")).alias("text"))


@query(f"SELECT doc_id, translate(text, '{text.LATIN}', '{text.PLAIN}') AS text FROM documents")
def fn_unaccent_latin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.unaccent_latin(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[^\sa-zA-Z0-9@]', ' ', 'g'), ' ') AS text FROM documents")
def fn_keep_alnum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.keep_alnum(F.col("text")).alias("text"))


@query(r"SELECT page_id, replace(url || '\end', '\', ' ') AS text FROM pages")
def fn_backslash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.drop_backslash(F.concat("url", F.lit("\\end"))).alias("text"))


@query("SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_]'), lambda x: x <> '') AS tokens FROM documents")
def fn_tokenise_nonword(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens_nonword(F.col("text")).alias("tokens"))


@query("SELECT doc_id, string_split(text, ' ') AS tokens FROM documents")
def fn_tokenise_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens_space(F.col("text")).alias("tokens"))


def _social_sql(extra: str, result: str, tag: str = "[lower(substr(t, 2))]") -> str:
    """The tokenizer for DuckDB: the same patterns, with letters written out where it has no reference to a group."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    whole = lambda k: f"regexp_matches(t, {q(social._whole(k))})"
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    straight = f"replace(t, '’', {q(chr(39))})"
    shorter = functools.reduce(lambda c, x: f"regexp_replace({c}, '{x}{{3,}}', '{x}{x}', 'g')", letters, "lower(t)")
    apart = functools.reduce(lambda c, s: f"regexp_replace({c}, {q(s[0])}, {q(s[1].replace('$1', chr(92) + '1'))}, 'g')", social.CONTRACTIONS, f"lower({straight})")
    clean = functools.reduce(lambda c, e: f"replace({c}, {q(e[0])}, {q(e[1])})", social.ENTITIES, "text")
    marks = []
    for kind, pattern in social.PATTERNS.items():
        if kind in social.MARKS:
            marks.append(f"WHEN {whole(kind)} THEN ['<{kind}>']")
        elif kind == "emphasis":
            marks.append(f"WHEN {whole(kind)} THEN [replace(lower(t), '*', ''), '<emphasis>']")
        elif kind == "censored":
            marks.append(f"WHEN {whole(kind)} THEN [lower(t), '<censored>']")
        elif kind == "repeated":
            marks.append(f"WHEN regexp_matches(t, {q(f'^(?:{pattern})$')}) THEN [t[1], '<repeated>']")
    case = rf"""CASE WHEN regexp_matches(lower(t), '{"|".join(f"{x}{{3}}" for x in letters)}') THEN [{shorter}, '<elongated>'] WHEN regexp_matches(t, '^[a-z]+$') THEN [t]
      WHEN regexp_matches(t, '^\p{{Lu}}{{2,}}$') THEN ['<allcaps>', lower(t), '</allcaps>'] WHEN t[1] = '#' THEN CASE WHEN {whole("hashtag")} THEN list_concat(['<hashtag>'], {tag}, ['</hashtag>']) ELSE [lower(t)] END
      WHEN regexp_matches(t, '^\p{{L}}+$') THEN [lower(t)] WHEN contains({straight}, {q(chr(39))}) AND {whole("word")} THEN string_split({apart}, ' ') {" ".join(marks)} ELSE [lower(t)] END"""
    return f"""
d AS (SELECT doc_id, {extra} AS text FROM documents),
r AS (SELECT doc_id, list_transform(regexp_extract_all({clean}, {q(social.ALTERNATION)}), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS l FROM d),
e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM r),
c AS (SELECT e.doc_id, i, {case} AS m FROM e {"LEFT JOIN tagged ON tag = t" if "words" in tag else ""})
{result}"""


#: What these tables lack, behind every text: contractions, emoticons, marks and annotations.
TAILS = (" I can't :-) it's", " :( <3 they're &amp; &lt;3 co-op", " 50% of $1,200.50 at 10:30am on 2021-03-04, call +1 (743) 555-3824 or a.b@c.de @me www.x.yz", " SO goooood *very* f**k !!! ?! Jan 5, 2020 24be 3.5")
_TAIL_SQL = "text || CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, t in enumerate(TAILS)) + " END"
_FIRST_TWO = r"array_to_string(list_slice(regexp_extract_all(lower(text), '\p{L}+'), 1, 2), '')"


def _tailed(spark, sf_dir):
    tail = functools.reduce(lambda c, k: c.when(F.col("doc_id") % 4 == k, TAILS[k]), range(1, 4), F.when(F.col("doc_id") % 4 == 0, TAILS[0]))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))


@query("WITH" + _social_sql(_TAIL_SQL, "SELECT doc_id, flatten(list(m ORDER BY i)) AS tokens FROM c GROUP BY doc_id"))
def fn_tokenise_social(spark, sf_dir):
    """All marks and annotations."""
    return _tailed(spark, sf_dir).select("doc_id", social.tokens_social(F.col("text")).alias("tokens"))


_TAGGED_SQL = rf"""
WITH RECURSIVE w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents) GROUP BY word),
total AS (SELECT sum(n) AS n FROM w),
known AS (SELECT word, CAST(round({social.UNIT} * (log10(total.n) - log10(w.n))) AS BIGINT) + 1 AS cost FROM w, total WHERE length(word) <= {social.LONGEST} ORDER BY w.n DESC, word LIMIT 20000),
tags AS (SELECT DISTINCT {_FIRST_TWO} AS tag FROM documents WHERE doc_id % 3 = 0),
path(tag, pos, best) USING KEY (tag, pos) AS (
  SELECT tag, CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'start': CAST(0 AS BIGINT), 'words': CAST([] AS VARCHAR[])}} FROM tags
  UNION
  SELECT p.tag, p.pos + 1, min({{'cost': b.best.cost + coalesce(k.cost, CAST(round({social.UNIT} * log10(total.n)) AS BIGINT) + 1 + {social.UNIT} * (p.pos + 1 - b.pos)), 'start': b.pos, 'words': list_append(b.best.words, substr(p.tag, b.pos + 1, p.pos + 1 - b.pos))}})
  FROM path p JOIN recurring.path b ON b.tag = p.tag AND b.pos <= p.pos CROSS JOIN total LEFT JOIN known k ON k.word = substr(p.tag, b.pos + 1, p.pos + 1 - b.pos)
  WHERE p.pos < length(p.tag) GROUP BY p.tag, p.pos
),
tagged AS (SELECT '#' || tag AS tag, best.words AS words FROM path WHERE pos = length(tag) AND pos > 0),"""


@query(_TAGGED_SQL + _social_sql(f"CASE WHEN doc_id % 3 = 0 THEN '#' || {_FIRST_TWO} || ' ' || text ELSE text END", "SELECT doc_id, flatten(list(m ORDER BY i)) AS tokens FROM c GROUP BY doc_id", "coalesce(words, [lower(substr(t, 2))])"))
def fn_segment_tags(spark, sf_dir):
    """Every third text begins with a tag of its first two words, which is cut by the counts of all texts' words."""
    docs = table(spark, sf_dir, "documents")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), 1, 2)
    tagged = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#"), F.array_join(words, ""), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    cutter = social.TagCutter(*social.word_counts(docs, "text", 20_000))
    return social.social_rows(docs.select("doc_id", tagged.alias("text")), "text", cutter).select("doc_id", "tokens")


@query("""
WITH t AS (SELECT item_id, list_slice(string_split(text, ' '), 1, 12) AS w FROM benchmark),
     p AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT a.item_id, a.w[a.i] AS first, a.w[b.i] AS second, count(*) AS n FROM p a JOIN p b ON a.item_id = b.item_id AND b.i > a.i AND b.i <= a.i + 3 GROUP BY ALL
""")
def fn_kskipgram(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.skipgrams(F.slice(text.tokens_space(F.col("text")), 1, 12), 2, 2)).alias("g"))
    return items.groupBy("item_id", F.col("g")[0].alias("first"), F.col("g")[1].alias("second")).agg(F.count("*").alias("n"))


@query("""
WITH x(word, score) AS (VALUES ('the', 0.5), ('and', -1.0), ('of', 2.0), ('que', 0.25), ('die', -0.5)),
     s AS (SELECT d.doc_id, x.score FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) d JOIN x ON d.w = x.word)
SELECT doc_id, count(*) AS n_scored, avg(score) AS sentiment FROM s GROUP BY doc_id
""")
def fn_lexicon_score(spark, sf_dir):
    """Mean lexicon score of a text's tokens; texts without lexicon words are left out."""
    from postloom.operators.lift import lexicon_scores

    lexicon = spark.createDataFrame([("the", 0.5), ("and", -1.0), ("of", 2.0), ("que", 0.25), ("die", -0.5)], "word string, score double")
    return lexicon_scores(table(spark, sf_dir, "documents"), lexicon)


@query("SELECT event_id, round((1 / (1 + exp(-(0.02 * value - 3))) + 1 / (1 + exp(-(0.01 * value - 1)))) / 2, 9) AS p FROM events")
def fn_sigmoid_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scalar.sigmoid_mean(F.col("value"), [(0.02, -3.0), (0.01, -1.0)]), 9).alias("p"))


@query("SELECT count(*) AS n, round(3.0 / 0.02, 6) AS root FROM events WHERE value >= 150.0")
def fn_root_find(spark, sf_dir):
    """Rows whose calibrated score is a half or more: the root in closed form, checked by bisection."""
    import math

    root = scalar.sigmoid_root(0.02, -3.0)
    assert abs(root - scalar.bisect_root(lambda x: 1 / (1 + math.exp(-(0.02 * x - 3))) - 0.5, 0, 1000)) < 1e-6
    return table(spark, sf_dir, "events").filter(F.col("value") >= root).agg(F.count("*").alias("n"), F.lit(round(root, 6)).alias("root"))


@query("SELECT event_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS bucket FROM (SELECT event_id, list_transform([0, 25, 100, 250, 500], lambda x: abs(x - value)) AS d FROM events)")
def fn_find_nearest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.nearest_index(F.array(*map(F.lit, (0.0, 25.0, 100.0, 250.0, 500.0))), F.col("value")).alias("bucket"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, strftime(o_orderdate, '%Y-%m-%d') AS label, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS age FROM orders")
def fn_date_parts(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), F.date_format(day, "yyyy-MM-dd").alias("label"), F.datediff(day.cast("date"), F.lit("1995-01-01").cast("date")).alias("age"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, make_date(year(o_orderdate), 1, 1) AS first_day, make_date(year(o_orderdate), 12, 31) AS last_day FROM orders")
def fn_period_bounds(spark, sf_dir):
    first, last = scalar.year_bounds(F.col("year"))
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct().select("year", first.alias("first_day"), last.alias("last_day"))


@query("SELECT event_id, least(greatest(value, 10.0), 100.0) AS clamped FROM events")
def fn_least_greatest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least(F.greatest("value", F.lit(10.0)), F.lit(100.0)).alias("clamped"))


@query("SELECT o_custkey, count(*) AS n, CASE WHEN max(o_orderdate) > min(o_orderdate) THEN count(*) / CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS DOUBLE) END AS rate FROM orders GROUP BY o_custkey")
def fn_activity_rate(spark, sf_dir):
    """Orders by active day; null where there is one day only."""
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.datediff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")).alias("days"))
    return by.select("o_custkey", "n", scalar.activity_rate(F.col("n"), F.col("days")).alias("rate"))


@query("SELECT DISTINCT CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS month_end FROM orders")
def fn_month_end(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(scalar.month_end(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_end")).distinct()


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS mean FROM embeddings")
def fn_array_build(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(scalar.array_mean(F.col("embedding")), 9).alias("mean"))


@query(r"SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(text, '^[[:ascii:]]*$') AS is_ascii, upper(text) = text AS is_upper, trim(text) = '' AS is_blank FROM documents")
def fn_char_class_tests(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", c.rlike("[0-9]").alias("has_digit"), c.rlike(r"^\p{ASCII}*$").alias("is_ascii"), (F.upper(c) == c).alias("is_upper"), (F.trim(c) == "").alias("is_blank"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS long_name, event_type AS kind FROM events")
def fn_geocode_pick(spark, sf_dir):
    """The nth result of a response, its parts picked by type."""
    response = F.to_json(F.struct(F.array(F.struct(F.lit("skip").alias("type"), F.lit(0).alias("k")), F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("results")))
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json(response, "results ARRAY<STRUCT<type: STRING, k: INT>>").alias("r"))
    picked = F.element_at(F.filter("r.results", lambda x: x["type"] != "skip"), 1)
    return parsed.select("event_id", picked["k"].alias("long_name"), picked["type"].alias("kind"))


@query("SELECT doc_id, make_timestamp(((doc_id * 1000003 * 4194304) >> 22) * 1000 + 1288834974657 * 1000) AS created_at FROM documents")
def fn_snowflake_time(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalar.id_time(F.col("doc_id") * 1000003 * 4194304).cast("timestamp_ntz").alias("created_at"))


@query("SELECT max(CAST(doc_id % 7 AS INTEGER)) AS last_iteration FROM documents")
def fn_path_regex(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("/data/iter_"), F.col("doc_id") % 7, F.lit("-x/part")).alias("path"))
    return paths.agg(F.max(scalar.path_number(F.col("path")).cast("int")).alias("last_iteration"))


@query("SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'of', 'die', 'que'])) AS INTEGER) AS common FROM documents")
def udf_text_intersect_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(F.split("text", " "), F.array(*map(F.lit, ("the", "of", "die", "que"))))).alias("common"))


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x IN ('the', 'of')) AS found FROM documents")
def udf_lexicon(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda t: t.isin("the", "of")).alias("found"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS at FROM embeddings")
def udf_nearest(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("at"))


@query("SELECT doc_id, list_has_all(string_split(lower(text), ' '), ['the', 'of']) AS first, list_has_all(string_split(lower(text), ' '), ['que', 'de']) AS second FROM documents")
def udf_match_tokens(spark, sf_dir):
    tokens = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", text.has_tokens(tokens, ["the", "of"]).alias("first"), text.has_tokens(tokens, ["que", "de"]).alias("second"))


@query("WITH" + _social_sql("text", "SELECT doc_id, CAST(sum(len(m)) AS INTEGER) AS n_tokens FROM c GROUP BY doc_id"))
def udf_tokenise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(social.tokens_social(F.col("text"))).alias("n_tokens"))
