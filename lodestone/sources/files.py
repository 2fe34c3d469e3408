"""Scans of files: texts, tables, JSON, XML, registries and settings, with files that can't be read set apart.

A path may be a folder, which is read with all its subfolders, or a pattern. Rows carry the file's path where a scan reads whole files.
A file that can't be read is one row of the second result, with the reason; an empty folder gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QNA_HEADERS = ("question", "q", "answer", "a")


def _contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files, in order of their paths; contents are not read."""
    return _contents(spark, path, pattern).select("path", "length").orderBy("path")


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text): whole files as UTF-8, bytes that are none replaced."""
    return _contents(spark, path, pattern).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with headers, all columns as strings, with `text`: the row's values joined, null where the headers are those of questions and answers."""
    rows = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("escape", '"').csv(path, header=True)
    known = {c.strip().lower() for c in rows.columns}
    plain = F.lit(None).cast("string") if known & set(QNA_HEADERS[:2]) and known & set(QNA_HEADERS[2:]) else F.concat_ws(" ", *(F.col(f"`{c}`") for c in rows.columns))
    return rows.withColumn("text", plain)


def json_rows(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """((path, item), (path, reason)): objects of JSON files that hold an array of objects, other JSON as one item each; files that don't parse."""
    files = text_files(spark, path, pattern).withColumn("parsed", F.try_parse_json("text"))
    good = files.where("parsed IS NOT NULL")
    items = F.from_json("text", "array<string>")
    several = F.regexp_extract("text", r"^\s*(\[)", 1) == "["
    each = good.select("path", F.explode(F.when(several, items).otherwise(F.array("text"))).alias("item"))
    return each, files.where("parsed IS NULL").select("path", F.lit("not JSON").alias("reason"))


def xml_text(text: Column) -> Column:
    """All text nodes of an XML document, trimmed, without blank ones, one on a line; entities of XML are read."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    nodes = F.filter(F.transform(F.split(bare, r"(?s)<[^>]*>"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    out = F.array_join(nodes, "\n")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def registry_line(line: Column) -> Column:
    """struct(tag, name, pairs) of a tab-separated line 'tag, name, k=v, k=v'; null for comments and blank lines."""
    parts = F.split(line, "\t")
    pairs = F.filter(F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2)), lambda p: F.contains(p, F.lit("=")))
    kv = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", ""))))
    return F.when(~line.rlike(r"^\s*(?:#|$)"), F.struct(F.get(parts, F.lit(0)).alias("tag"), F.get(parts, F.lit(1)).alias("name"), kv.alias("pairs")))


def settings(lines: DataFrame, file: str = "path", order: str = "n", line: str = "line") -> DataFrame:
    """(file, section, key, value) of lines of INI files; a key before any section is in the section ''. A file of settings is small: one group."""
    w = Window.partitionBy(file).orderBy(order)
    text = F.trim(line)
    head = F.nullif(F.regexp_extract(text, r"^\[([^\]]+)\]$", 1), F.lit(""))
    rows = lines.withColumn("section", F.coalesce(F.last(head, True).over(w), F.lit("")))
    pair = r"^([^=:#;\[]+?)\s*[=:]\s*(.*)$"
    return rows.where(text.rlike(pair)).select(file, "section", F.regexp_extract(text, pair, 1).alias("key"), F.regexp_extract(text, pair, 2).alias("value"))


def append_csv(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files with headers."""
    rows.write.mode("append").option("escape", '"').csv(path, header=True)


def chat_log(rows: DataFrame, path: str, per_user: bool = False) -> None:
    """Appends (ts, user, ...) as CSV, in a folder for each day; a null user is REST_API.

    A day's rows lie in the order of users, so one user's are read from a few places. `per_user` gives each user a folder of the day, which makes
    a file for every user and day: for a few users only.
    """
    out = rows.withColumns({"date": F.date_format("ts", "yyyy-MM-dd"), "user": F.coalesce("user", F.lit("REST_API"))})
    out = out if per_user else out.repartitionByRange("date", "user").sortWithinPartitions("date", "user", "ts")
    out.write.mode("append").partitionBy(*["date", "user"][: 1 + per_user]).option("escape", '"').csv(path, header=True)


def save_snapshot(entities: dict[str, DataFrame], path: str) -> None:
    """Writes each entity as a table below `path`, in place of an earlier snapshot."""
    for name, rows in entities.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
