"""Tables at rest: event records, the partitioned ledger, state snapshots, the outbox.

The ledger and outbox are append-only parquet, one folder per batch inside each bucket, so
writing a batch again replaces exactly that batch.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countersign import schemas
from countersign.functions.addresses import valid_event_id

BUCKETS = 256


def bucket_of(event_id: Column | str, buckets: int = BUCKETS) -> Column:
    """Folder an event's rows live in; a readers' filter on it prunes the scan."""
    c = F.col(event_id) if isinstance(event_id, str) else event_id
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _event_files(spark: SparkSession, path: str) -> DataFrame:
    """`stem, value` of every JSON file whose name is a usable event id; an event is looked up by its file name."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return files.select(stem.alias("stem"), "value").filter(valid_event_id("stem") & F.try_parse_json("value").isNotNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """S3. Event records, one JSON document per file; files that hold no JSON or have an unusable id are skipped.

    Fields that the schema lacks come back as a JSON object of strings in `extra`; signatures have
    a reader of their own.
    """
    known = T.StructType([f for f in schemas.COORD_EVENTS.fields if f.name != "extra"])
    docs = _event_files(spark, path).select(F.from_json("value", known).alias("r"), F.from_json("value", "map<string,string>").alias("all"))
    others = F.map_filter("all", lambda k, v: ~k.isin(*known.fieldNames(), "extra", "signatures"))
    extra = F.coalesce(F.when(F.size(others) > 0, F.to_json(others)), F.col("all")["extra"])
    return docs.select("r.*", extra.alias("extra")).select(*schemas.COORD_EVENTS.fieldNames())


def read_event_signatures(spark: SparkSession, path: str) -> DataFrame:
    """S3. The signatures that event records of a folder hold, one row each."""
    entry = T.StructType([f for f in schemas.SIGNATURES.fields if f.name != "event_id"])
    held = F.from_json("value", T.StructType([T.StructField("signatures", T.ArrayType(entry))]))
    return _event_files(spark, path).select(F.col("stem").alias("event_id"), F.inline(held["signatures"]))


def append_ledger(entries: DataFrame, path: str, batch_id: int | str, buckets: int = BUCKETS) -> None:
    """S8. Append one batch; repeating a batch id replaces that batch only."""
    rows = entries.withColumn("batch", F.lit(str(batch_id))).withColumn("bucket", bucket_of("event_id", buckets))
    # Spread a hot bucket over several writers, but give each bucket few files.
    rows = rows.repartition("bucket", F.floor(F.col("sequence") / (1 << 20)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def scan_ledger(spark: SparkSession, path: str, event_ids: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """S4. The stored ledger; naming events prunes to their buckets."""
    df = spark.read.parquet(path)
    if event_ids is None:
        return df
    wanted = spark.createDataFrame([(e,) for e in event_ids], "event_id string")
    hit = sorted({r[0] for r in wanted.select(bucket_of("event_id", buckets)).collect()})
    return df.filter(F.col("bucket").isin(hit) & F.col("event_id").isin(event_ids))


def write_state(df: DataFrame, path: str, version: int) -> None:
    """S9. Write a whole snapshot under its own version; a reader takes the newest marked one."""
    df.write.mode("overwrite").parquet(f"{path}/version={version:010d}")


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write finished, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("version=") and fs.exists(hadoop.Path(entry.getPath(), "_SUCCESS")):
            out.append(int(name.split("=")[1]))
    return sorted(out)


def read_state(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame | None:
    """S9. Newest finished snapshot, or the newest one below a version."""
    versions = [v for v in state_versions(spark, path) if below is None or v < below]
    if not versions:
        return None
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]:010d}")


def write_outbox(outbox: DataFrame, path: str, batch_id: int | str) -> None:
    """S11. One folder per batch; repeating a batch replaces it."""
    write_batch(outbox, path, batch_id)


def read_batches(spark: SparkSession, path: str, schema: str, below: int | str) -> DataFrame | None:
    """What earlier batches appended; NULL columns stay, a path that nobody wrote gives None."""
    try:
        rows = spark.read.schema(f"{schema}, batch string").parquet(path)
    except AnalysisException:
        return None
    return rows.filter(F.col("batch") < str(below)).drop("batch")


def write_batch(rows: DataFrame, path: str, batch_id: int | str) -> None:
    """Append one batch's rows; an empty batch replaces what an earlier try of it wrote."""
    void = {c: F.col(c).cast("string") for c, kind in rows.dtypes if kind == "void"}
    rows.withColumns(void).withColumn("batch", F.lit(str(batch_id))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def mirror_digests(state: DataFrame, key: str = "id") -> DataFrame:
    """S10. What a mirror remembers of the rows it holds."""
    from countersign.functions.hashing import canonical_json

    return state.select(key, F.sha2(canonical_json(*state.columns), 256).alias("digest"))
