"""A snapshot kept up to date by changes that may come late, version by version.

The snapshot lies in BUCKETS by the hash of the key. A version writes the buckets in which a row has changed, and a manifest that says, for
every bucket, which version holds it; readers take a version's manifest, so they see all of it or nothing. Of two rows with one key the one with
the greater order counts, whenever it comes; rows are never deleted by a change. A version that is written again gives the same files.

Defined cases: rows without a key are left out; a null order is older than any other; of equal orders the stored row stays, and within one set of changes
the greatest row does; a set without news writes a manifest only; a path without a version is an empty snapshot. The snapshot has the columns of
the changes and `bucket_`, `version_` for its own use; changes must not have columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64
BUCKET, VERSION = "bucket_", "version_"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(version_, bucket_, held): which version holds each bucket, for every version there is."""
    schema = f"{BUCKET} int, held long, {VERSION} long"
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def snapshot(spark: SparkSession, path: str, schema: StructType, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of the newest version (of those below `before`), with their bucket. `only` reads these buckets alone."""
    m = manifests(spark, path)
    m = m if before is None else m.where(F.col(VERSION) < before)
    newest = m.agg(F.max(VERSION)).first()[0]
    rows = m.where(F.col(VERSION) == newest).select(BUCKET, "held").collect() if newest is not None else []
    folders = [f"{path}/data/{VERSION}={r.held}/{BUCKET}={r[BUCKET]}" for r in rows if only is None or r[BUCKET] in only]
    full = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders).select(*full.names)


def merge(changes: DataFrame, path: str, key: str, order: str, version: int, buckets: int = BUCKETS) -> None:
    """Writes version `version`: the one before it with `changes`. Only buckets with news are read and written."""
    spark, schema = changes.sparkSession, changes.schema
    whole = F.struct(F.col(order).isNotNull().alias("dated"), F.col(order).alias("at"), F.struct(*[F.col(c) for c in changes.columns]).alias("row"))
    latest = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(whole).alias("new")).select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET), "new.row.*")
    touched = [r[0] for r in latest.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
    old = snapshot(spark, path, schema, before=version, only=touched)
    known = old.select(key, F.col(order).alias("known_"), F.lit(True).alias("there_"))
    newer = F.col("there_").isNull() | (F.col(order) > F.col("known_")) | (F.col(order).isNotNull() & F.col("known_").isNull())
    won = latest.join(known, key, "left").where(newer).select(*changes.columns, BUCKET)
    news = [r[0] for r in won.select(BUCKET).distinct().collect()]
    if news:
        stays = old.where(F.col(BUCKET).isin(news)).join(won.select(key), key, "left_anti").select(*changes.columns, BUCKET)
        stays.unionByName(won).repartition(min(len(news), buckets), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/{VERSION}={version}")
    m = manifests(spark, path).where(F.col(VERSION) < version)
    newest = m.agg(F.max(VERSION)).first()[0]
    held = {r[BUCKET]: r.held for r in m.where(F.col(VERSION) == newest).collect()} if newest is not None else {}
    held |= dict.fromkeys(news, version)
    rows = spark.createDataFrame(sorted(held.items()), f"{BUCKET} int, held long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{VERSION}={version}")


def synced(changes: DataFrame, path: str, key: str, order: str, interval: str = "60 seconds", buckets: int = BUCKETS) -> DataStreamWriter:
    """The periodic sync of a stream of changes: each batch is a version. A batch that runs again writes its version again."""
    run = lambda rows, batch: merge(rows.persist(), path, key, order, batch, buckets)

    def once(rows: DataFrame, batch: int) -> None:
        try:
            run(rows, batch)
        finally:
            rows.unpersist()

    return changes.writeStream.foreachBatch(once).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime=interval)


def trimmed(spark: SparkSession, path: str, keep: int = 3) -> list[int]:
    """Deletes manifests but the newest `keep`, and data that none of these names; gives the versions whose data went."""
    all_rows = manifests(spark, path).collect()  # one row for each bucket and version that is left
    versions = sorted({r[VERSION] for r in all_rows})
    kept = set(versions[-keep:]) if keep else set()
    used = {(r.held, r[BUCKET]) for r in all_rows if r[VERSION] in kept}
    fs = lambda p: (spark._jvm.org.apache.hadoop.fs.Path(p), spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()))
    gone = set()
    for folder in [f"{path}/manifest/{VERSION}={v}" for v in versions if v not in kept]:
        p, system = fs(folder)
        system.delete(p, True)
    for held, bucket in {(r.held, r[BUCKET]) for r in all_rows} - used:
        p, system = fs(f"{path}/data/{VERSION}={held}/{BUCKET}={bucket}")
        system.delete(p, True)
        gone.add(held)
    return sorted(gone)
