"""Readers of raw posts, reference tables and listings. Schemas are declared; bad rows are named, not lost silently."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.session import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, *, mode: str = "FAILFAST", header: bool = True, multiline: bool = True, **options) -> DataFrame:
    """CSV whose fields may hold line feeds and doubled quotes; the codec follows from the file's name."""
    reader = spark.read.options(header=header, multiLine=multiline, escape='"', encoding="UTF-8", mode=mode, **options)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def borrow_schema(spark: SparkSession, sample: str, kind: str = "csv", **options) -> StructType:
    """The schema of one sample file, for all files of a glob: no pass over all of them."""
    return spark.read.format(kind).options(**options).load(sample).schema


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | str, *, multiline: bool = False, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).options(multiLine=multiline, mode=mode).json(path)


def read_partition(spark: SparkSession, root: str, kind: str = "parquet", **parts) -> DataFrame:
    """One partition of a partitioned folder without its partition columns; the filter prunes the folders read."""
    rows = spark.read.format(kind).load(root)
    for name, value in parts.items():
        rows = rows.filter(F.col(name) == value)
    return rows.drop(*parts)


def marked_json(spark: SparkSession, path: str, schema: str, markers: list[str]) -> DataFrame:
    """JSON lines that hold one of the markers; the rest is never parsed, and lines that don't parse are dropped."""
    lines = spark.read.text(path)
    hit: Column = F.lit(False)
    for m in markers:
        hit = hit | F.col("value").contains(m)
    parsed = lines.filter(hit).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"))
    return parsed.filter("row IS NOT NULL").select("row.*")


def corrupt_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file with its number of rows and of rows that don't parse, in one job over all files."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), parsed.alias("r"))
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.count("r._corrupt_record").alias("n_corrupt"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and time of the files; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def file_chunk(n: int, path: Column | None = None) -> Column:
    """Which of ``n`` chunks a file belongs to, the same in every run."""
    return F.pmod(F.xxhash64(path if path is not None else F.input_file_name()), F.lit(n)).cast("int")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(done.select(key), key, "left_anti")


def files_between(files: DataFrame, first: str, last: str, expected: int | None = None, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Files whose name has a date between two, inclusive; raises if their number isn't the expected one."""
    dated = files.withColumn("date", F.to_date(F.regexp_extract("path", pattern, 1))).filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if expected is not None and (n := dated.count()) != expected:
        raise ValueError(f"{n} files between {first} and {last}, not {expected}")
    return dated


def since(posts: DataFrame, latest: DataFrame, user: str, post_id: str) -> DataFrame:
    """Posts newer than the newest known one of their user, and all posts of new users."""
    known = latest.select(F.col(user), F.col("last_id"))
    return posts.join(known, user, "left").filter(F.col("last_id").isNull() | (F.col(post_id) > F.col("last_id"))).drop("last_id")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """user_id, tar and member of all files in tar archives; one archive is opened in one task."""
    import io
    import tarfile

    import pandas as pd

    def index(frames):
        for frame in frames:
            rows = []
            for tar, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    rows += [(m.name.rsplit("/", 1)[-1].split(".")[0], tar.rsplit("/", 1)[-1], m.name) for m in archive if m.isfile()]
            yield pd.DataFrame(rows, columns=["user_id", "tar", "member"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(index, "user_id string, tar string, member string")


def unpivot_months(wide: DataFrame, key: str, value: str = "rate", after: str | None = None) -> DataFrame:
    """A wide table with a column for each period to rows (key, period, value); percentages become shares."""
    periods = [c for c in wide.columns if c != key]
    rows = wide.unpivot(key, periods, "period", value).withColumn(value, F.col(value) / 100)
    return rows.filter(F.col("period") >= after) if after else rows


def lookup(frame: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """A join that broadcasts the small side only if it has at most ``most`` rows; else Spark deals both sides."""
    fits = small.limit(most + 1).count() <= most
    return frame.join(F.broadcast(small) if fits else small, key, how)
