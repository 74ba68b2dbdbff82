"""Queries that write a table in some form and read it again, or read it in a special way."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.plans.registry import query
from postloom.session import table
from postloom.sources import readers, writers

EVENTS = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
EVENTS_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", "props")


def _written(spark, rows, kind, name="", **options):
    path = f"{readers.scratch(spark)}{name}"
    rows.write.format(kind).options(**options).save(path)
    return path


@query("SELECT doc_id, text, lang FROM documents")
def src_csv_bz2(spark, sf_dir):
    path = _written(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "csv", compression="bzip2", header=True, escape='"', quoteAll=True)
    return readers.read_csv(spark, f"{path}/*.csv.bz2", "doc_id BIGINT, text STRING, lang STRING")


@query("SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0")
def src_csv_dropmalformed(spark, sf_dir):
    bad = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("event_id").cast("string"))
    path = _written(spark, table(spark, sf_dir, "events").select(bad.alias("event_id"), "user_id"), "csv", header=True)
    rows = readers.read_csv(spark, path, "event_id BIGINT, user_id BIGINT", mode="DROPMALFORMED")
    return rows.filter("event_id IS NOT NULL")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def src_csv_header(spark, sf_dir):
    path = _written(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "csv", header=True)
    return readers.read_csv(spark, path)


@query("SELECT n_name AS word, CAST(n_nationkey AS INTEGER) AS score FROM nation")
def src_csv_infer(spark, sf_dir):
    path = _written(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("score")), "csv", header=True, sep=";")
    return spark.read.csv(path, header=True, inferSchema=True, sep=";")


@query("SELECT n_name AS _c0 FROM nation")
def src_csv_headerless(spark, sf_dir):
    return spark.read.csv(_written(spark, table(spark, sf_dir, "nation").select("n_name"), "csv"))


@query("SELECT CAST(event_id AS VARCHAR) AS tweet_id, CAST(value AS FLOAT) AS score, event_type AS target FROM events")
def src_csv_nonnull_schema(spark, sf_dir):
    from pyspark.sql.types import FloatType, StringType, StructField, StructType

    schema = StructType([StructField("tweet_id", StringType(), False), StructField("score", FloatType(), False), StructField("target", StringType(), False)])
    path = _written(spark, table(spark, sf_dir, "events").selectExpr("event_id", "CAST(value AS FLOAT) AS value", "event_type"), "csv", header=True)
    return readers.read_csv(spark, path, schema)


@query(EVENTS_SQL)
def src_json_multiline(spark, sf_dir):
    """Each file is one JSON document, an array of rows."""
    rows = _events(spark, sf_dir).groupBy(F.pmod(F.xxhash64("event_id"), F.lit(8)).alias("k")).agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "event_type", "value", "props"))).alias("value"))
    path, parts = readers.scratch(spark), []
    for k in range(8):
        rows.filter(F.col("k") == k).select("value").coalesce(1).write.text(f"{path}-{k}")
        parts.append(f"{path}-{k}")
    return readers.read_json(spark, parts, EVENTS, multiline=True)


@query(EVENTS_SQL)
def src_json_lines(spark, sf_dir):
    return readers.read_json(spark, _written(spark, _events(spark, sf_dir), "json"), EVENTS)


@query(EVENTS_SQL)
def src_json_file_list(spark, sf_dir):
    rows = _events(spark, sf_dir)
    paths = [_written(spark, rows.filter(F.col("event_id") % 2 == k), "json") for k in (0, 1)]
    return readers.read_json(spark, paths, EVENTS)


@query(EVENTS_SQL)
def src_parquet_glob(spark, sf_dir):
    path = _written(spark, _events(spark, sf_dir), "parquet", name="/part=a")
    return spark.read.parquet(f"{path.rsplit('/', 1)[0]}/*/*.parquet")


@query(EVENTS_SQL)
def src_orc(spark, sf_dir):
    return spark.read.orc(_written(spark, _events(spark, sf_dir), "orc"))


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def src_partition_dir(spark, sf_dir):
    path = writers.write(table(spark, sf_dir, "events").select("event_id", "value", "event_type"), readers.scratch(spark), by=("event_type",))
    return readers.read_partition(spark, path, event_type="view")


@query("SELECT count(*) AS n FROM events")
def src_ignore_corrupt(spark, sf_dir):
    path = _written(spark, _events(spark, sf_dir), "parquet")
    spark.createDataFrame([("not a parquet file",)], "value string").coalesce(1).write.mode("append").text(f"{path}/extra=1")
    return spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).schema(EVENTS).parquet(path).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(count(*) FILTER (event_id % 7 = 0) AS BIGINT) AS n_corrupt FROM events")
def src_probe_corrupt(spark, sf_dir):
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "value")))
    path = _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "text")
    return readers.corrupt_rows(spark, path, "event_id BIGINT, value DOUBLE").agg(F.sum("n").alias("n"), F.sum("n_corrupt").alias("n_corrupt"))


@query("SELECT event_type, CAST(1 AS BIGINT) AS n_folders FROM events GROUP BY event_type")
def src_fs_glob(spark, sf_dir):
    path = writers.write(table(spark, sf_dir, "events").select("event_id", "event_type"), readers.scratch(spark), by=("event_type",))
    files = readers.list_files(spark, path, "*.parquet").select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type"))
    return files.distinct().groupBy("event_type").agg(F.count("*").alias("n_folders"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, true AS all_chunks FROM events")
def src_shuffle_chunks(spark, sf_dir):
    """Files dealt into chunks by a hash of their path; all chunks together are all rows."""
    rows = spark.read.parquet(_written(spark, _events(spark, sf_dir).repartition(8), "parquet")).withColumn("chunk", readers.file_chunk(3))
    return rows.agg(F.count("*").alias("n"), (F.count_if(F.col("chunk").between(0, 2)) == F.count("*")).alias("all_chunks"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def src_resume(spark, sf_dir):
    return readers.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def _lines(spark, sf_dir):
    """Raw lines: posts with and without users and places, and broken ones."""
    post_id = F.col("event_id").cast("string")
    user = F.when(F.col("event_id") % 3 == 0, F.struct(post_id.alias("id_str"), F.col("event_type").alias("location")))
    place = F.when(F.col("event_id") % 4 == 0, F.struct(F.lit("p").alias("id")))
    post = F.to_json(F.struct(post_id.alias("id_str"), user.alias("user"), place.alias("place")))
    line = F.when(F.col("event_id") % 11 == 0, F.lit('{"location":"broken')).otherwise(post)
    return _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "text")


@query("SELECT CAST(event_id AS VARCHAR) AS id_str, event_type AS location FROM events WHERE event_id % 3 = 0 AND event_id % 11 <> 0")
def src_xz_prefilter(spark, sf_dir):
    rows = readers.marked_json(spark, _lines(spark, sf_dir), "id_str STRING, user STRUCT<id_str: STRING, location: STRING>", ['"location":"'])
    return rows.filter("id_str IS NOT NULL").select("id_str", F.col("user.location").alias("location"))


@query("SELECT CAST(event_id AS VARCHAR) AS user_id, event_type AS user_location FROM events WHERE event_id % 3 = 0 AND event_id % 11 <> 0")
def src_xz_user_loc(spark, sf_dir):
    rows = readers.marked_json(spark, _lines(spark, sf_dir), "user STRUCT<id_str: STRING, location: STRING>", ['"location":"'])
    return rows.filter("user IS NOT NULL").select(F.col("user.id_str").alias("user_id"), F.col("user.location").alias("user_location"))


@query("SELECT CAST(event_id AS VARCHAR) AS id_str FROM events WHERE event_id % 4 = 0 AND event_id % 11 <> 0")
def src_xz_geo(spark, sf_dir):
    rows = readers.marked_json(spark, _lines(spark, sf_dir), "id_str STRING, place STRUCT<id: STRING>, coordinates STRUCT<coordinates: ARRAY<DOUBLE>>", ['"coordinates":{', '"place":{'])
    return rows.filter("place IS NOT NULL OR coordinates IS NOT NULL").select("id_str")


@query("SELECT count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06' - INTERVAL 1 MICROSECOND")
def src_file_date_range(spark, sf_dir):
    """Rows of the files whose folder's date is in the range."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = writers.write(rows.select("event_id", "day"), readers.scratch(spark), by=("day",))
    files = readers.files_between(readers.list_files(spark, path, "*.parquet"), "2024-01-03", "2024-01-05")
    chosen = [r.path for r in files.select("path").collect()]  # a file name for each file of the range
    return spark.read.parquet(*chosen).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events e WHERE event_id > (SELECT max(event_id) FROM events l WHERE l.user_id = e.user_id AND l.event_id % 2 = 0) OR NOT EXISTS (SELECT 1 FROM events l WHERE l.user_id = e.user_id AND l.event_id % 2 = 0)")
def src_api_pull(spark, sf_dir):
    """The refresh of a timeline: posts newer than the newest one that is known of the user."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    latest = events.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    return readers.since(events, latest, "user_id", "event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 9 <> 0")
def src_json_dict_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 9 == 0, F.lit("{'oops'")).otherwise(F.concat(F.lit("{'event_id': "), F.col("event_id"), F.lit(", 'k': "), F.get_json_object("props", "$.k"), F.lit("}")))
    path = _written(spark, table(spark, sf_dir, "events").select(line.alias("value")), "text")
    rows = spark.read.text(path).select(F.from_json("value", "event_id BIGINT, k INT", {"mode": "PERMISSIVE", "allowSingleQuotes": "true"}).alias("r"))
    return rows.select("r.*").filter("event_id IS NOT NULL")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS user_id, 'a.tar' AS tar, 'pictures/' || n_nationkey || '.txt' AS member FROM nation")
def src_tar_index(spark, sf_dir):
    """Archives are made from bytes in a table, written through Spark, so that any store will do."""
    import io
    import tarfile

    names = [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # a row a nation
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as archive:
        for n in names:
            archive.addfile(tarfile.TarInfo(f"pictures/{n}.txt"))
    path = readers.scratch(spark)
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/a.tar")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    return readers.tar_members(spark, path)


@query("SELECT n_nationkey, period, rate FROM (SELECT n_nationkey, '2010-01' AS period, n_nationkey / 100 AS rate FROM nation UNION ALL SELECT n_nationkey, '2010-02', (n_nationkey + 1) / 100 FROM nation)")
def src_excel_official(spark, sf_dir):
    wide = table(spark, sf_dir, "nation").select("n_nationkey", *((F.col("n_nationkey") + k).alias(p) for k, p in ((0, "2010-01"), (1, "2010-02"), (5, "2009-12"))))
    return readers.unpivot_months(wide, "n_nationkey", after="2010")


@query("SELECT point, rank, event_id FROM (VALUES (1, 10), (2, 20), (3, 30)) AS t(point, rank) JOIN (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events) USING (rank)")
def src_local_rows(spark, sf_dir):
    """Rows of the program's own, points and ranks, with the events of these ranks."""
    from postloom.operators.retrieval import ranked

    points = spark.createDataFrame(list(zip((1, 2, 3), (10, 20, 30), strict=True)), "point int, rank int")
    events = ranked(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")
    return readers.lookup(events, points, "rank").select("point", F.col("rank").cast("int").alias("rank"), "event_id")


@query(EVENTS_SQL)
def sink_parquet_overwrite(spark, sf_dir):
    path = writers.write(_events(spark, sf_dir).limit(5), readers.scratch(spark))
    return spark.read.parquet(writers.write(_events(spark, sf_dir), path))


@query("SELECT event_id, 'a' AS ngram FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'b' FROM events WHERE event_type = 'click'")
def sink_parquet_append(spark, sf_dir):
    """Slices of all n-grams in one job, a folder each, appended to what is there."""
    path, events = readers.scratch(spark), table(spark, sf_dir, "events")
    slices = events.filter("event_type IN ('view', 'click')").select("event_id", F.when(F.col("event_type") == "view", "a").otherwise("b").alias("ngram"))
    writers.write(slices.filter("event_id % 2 = 0"), path, mode="append", by=("ngram",))
    return spark.read.parquet(writers.write(slices.filter("event_id % 2 = 1"), path, mode="append", by=("ngram",)))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def sink_orc_partitioned(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return spark.read.orc(writers.write(rows, readers.scratch(spark), "orc", by=("year", "month")))


@query(EVENTS_SQL)
def sink_json(spark, sf_dir):
    return readers.read_json(spark, writers.write(_events(spark, sf_dir), readers.scratch(spark), "json"), EVENTS)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def sink_csv_single(spark, sf_dir):
    path = writers.write_single_csv(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), readers.scratch(spark))
    return readers.read_csv(spark, path, "event_type STRING, n BIGINT")


@query(EVENTS_SQL)
def sink_repartitioned(spark, sf_dir):
    return spark.read.parquet(writers.write(_events(spark, sf_dir).hint("rebalance"), readers.scratch(spark), max_records=5000))


@query(EVENTS_SQL)
def sink_orc_to_parquet(spark, sf_dir):
    source = writers.write(_events(spark, sf_dir), readers.scratch(spark), "orc")
    return spark.read.parquet(writers.convert(spark, source, readers.scratch(spark)))


@query("SELECT DISTINCT event_type FROM events")
def sink_driver(spark, sf_dir):
    """Values of a small parameter table at the driver."""
    values = sorted(r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # one for each event type
    return spark.createDataFrame([(v,) for v in values], "event_type string")


@query("SELECT 'f' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' ELSE 'size' END AS state FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0")
def sink_file_copy_diff(spark, sf_dir):
    left = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey")).alias("path"), F.col("n_nationkey").alias("length"))
    right = left.filter("length % 5 <> 0").withColumn("length", F.when(F.col("length") % 7 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return writers.listing_difference(left, right)
