"""Structured Streaming versions of the log and scoring jobs (STR-1..4).

All queries take their checkpoint location under the shared
``spark.checkpoint.dir`` folder, so a restarted driver resumes exactly where
it stopped.  ``run_complete`` and ``run_append`` drain what is there now
(``availableNow``) into files, never into the driver; production use is the same query with a
processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import latest_per_id
from ..session import hadoop_path, path_exists, scratch_path, stored
from ..sources.logs import CORRUPT, parse_lines


def log_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
               max_files: int | None = None) -> DataFrame:
    """STR-1 source: JSON lines (malformed lines kept in ``_corrupt_record``)
    or parquet, explicit schema, no inference."""
    r = spark.readStream.format(fmt)
    if fmt == "json":
        schema = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.schema(schema).load(path)


def _write_epoch(batch: DataFrame, path: str, epoch: int) -> None:
    """One micro-batch in a folder of its own: a replayed one replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/v{epoch:08d}")


def read_epochs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All micro-batches that ``_write_epoch`` left under ``path``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def ingest_with_quarantine(stream: DataFrame, good_path: str, bad_path: str,
                           checkpoint: str):
    """STR-1 sink: good records as parquet, malformed lines to a quarantine
    table, both per micro-batch; read them with ``read_epochs``."""

    def write(batch: DataFrame, epoch: int) -> None:
        if CORRUPT in batch.columns:
            # The corrupt column alone cannot be read from text: every field is named by the first write.
            whole = f"{bad_path}-parsed/v{epoch:08d}"
            batch.write.mode("overwrite").parquet(whole)
            parsed = batch.sparkSession.read.parquet(whole)
            _write_epoch(parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), good_path, epoch)
            _write_epoch(parsed.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT), bad_path, epoch)
        else:
            _write_epoch(batch, good_path, epoch)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """STR-1 source of whole lines: (line, file), nothing parsed and nothing dropped."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def ingest_lines(lines: DataFrame, schema: T.StructType, path: str, checkpoint: str):
    """STR-1 sink with both sides: each micro-batch parsed once (``parse_lines``) into a folder of its own,
    good and faulty lines in a part each, with file and epoch; a replayed epoch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        (parse_lines(batch, schema).withColumns({"epoch": F.lit(epoch).cast("long"), "good": F.col("fault").isNull()})
         .write.mode("overwrite").partitionBy("good").parquet(f"{path}/v{epoch:08d}"))

    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_ingested(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, faulty lines) of all whole epochs under ``path``: records with file and epoch, lines with their fault too."""
    full = T.StructType([T.StructField("line", T.StringType()), T.StructField("file", T.StringType()),
                         T.StructField("fault", T.StringType()), T.StructField("record", schema),
                         T.StructField("epoch", T.LongType())])
    whole = [f"{path}/v{v:08d}" for v in _versions(spark, path)]

    def side(good: str) -> DataFrame:
        parts = [f"{w}/good={good}" for w in whole if path_exists(spark, f"{w}/good={good}")]
        return spark.read.schema(full).parquet(*parts) if parts else spark.createDataFrame([], full)

    return side("true").select("record.*", "file", "epoch"), side("false").select("line", "file", "fault", "epoch")


def daily_event_counts(stream: DataFrame, ts: str = "ts", event: str = "event_type",
                       watermark: str = "1 day") -> DataFrame:
    """STR-2: counts per (1-day window, event type) with a watermark.

    The event-time column must be ``timestamp`` (watermarks reject NTZ), so
    it is cast here; the session time zone is UTC.
    """
    t = F.col(ts).cast("timestamp")
    return (stream.withColumn("__t", t).withWatermark("__t", watermark)
            .groupBy(F.window("__t", "1 day").alias("w"), F.col(event))
            .agg(F.count(F.lit(1)).alias("n")))


def run_complete(df: DataFrame, name: str) -> DataFrame:
    """Drain the source once in complete mode; the last result table, from shared files."""
    spark = df.sparkSession
    out = scratch_path(spark, f"complete-{name}")
    q = (df.writeStream.foreachBatch(lambda batch, epoch: _write_epoch(batch, out, epoch))
         .outputMode("complete").option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    done = _versions(spark, out)
    return spark.read.parquet(f"{out}/v{done[-1]:08d}") if done else spark.createDataFrame([], df.schema)


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Drain the source once into parquet files in the shared folder and read them."""
    spark = df.sparkSession
    out = scratch_path(spark, f"append-{name}")
    q = (df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_closed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Drain the source in append mode: the windows that the watermark has closed, each written once and for good,
    and the number of rows that came too late for theirs."""
    spark = df.sparkSession
    out = scratch_path(spark, f"closed-{name}")
    q = (df.writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}")).trigger(availableNow=True).start())
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(df.schema).parquet(out), late


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """STR-3: the batch scoring projection applied to a stream (stateless)."""
    return scorer(stream)


BUCKET = "__bucket"
#: Hash buckets of the latest-per-id state; a batch rewrites those that its ids fall in.
BUCKETS = 64


def merge_latest(state_path: str, id_col: str, date_col: str, tiebreak: str, buckets: int = BUCKETS
                 ) -> Callable[[DataFrame, int], None]:
    """STR-4 ``foreachBatch`` body: DED-1 of (stored latest rows ∪ new batch).

    The state lies in hash buckets of the id.  A batch is reduced to its own latest
    rows, meets the stored rows of the buckets that it touches, and writes those buckets
    as a version of its own; all others stay as they are.  A manifest (bucket, version),
    written last, is the switch: until then readers see the state before.

    A replayed epoch starts from the newest whole manifest before it, reads the same
    input and replaces only itself.  Files that neither of the last two manifests names
    are removed.
    """

    def body(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")
        # A hot id, or the NULL ids, come down to one row here, before the rows move to their buckets.
        new = stored(latest_per_id(batch, id_col, date_col, tiebreak).withColumn(BUCKET, bucket), "batch")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # ``buckets`` numbers at most
        before = [v for v in _versions(spark, f"{state_path}/manifest") if v < epoch]
        table = _manifest(spark, state_path, before[-1]) if before else {}
        kept = [_bucket_path(state_path, table[b], b) for b in touched if b in table]
        merged = new
        if kept:
            state = spark.read.schema(new.drop(BUCKET).schema).parquet(*kept).withColumn(BUCKET, bucket)
            merged = latest_per_id(state.unionByName(new).repartition(BUCKET), id_col, date_col, tiebreak, [BUCKET])
        else:
            merged = merged.repartition(BUCKET)
        merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{state_path}/v{epoch:08d}")
        rows = sorted({**table, **dict.fromkeys(touched, epoch)}.items())
        _write_epoch(spark.createDataFrame(rows, "bucket int, version long").coalesce(1), f"{state_path}/manifest", epoch)
        live = {_bucket_path("", v, b) for t in (table.items(), rows) for b, v in t}
        hpath, fs = hadoop_path(spark, f"{state_path}/v*/{BUCKET}=*")
        for x in fs.globStatus(hpath) or []:
            part = x.getPath()
            if f"/{part.getParent().getName()}/{part.getName()}" not in live:
                fs.delete(part, True)

    return body


def _bucket_path(state_path: str, version: int, bucket: int) -> str:
    return f"{state_path}/v{version:08d}/{BUCKET}={bucket}"


def _manifest(spark: SparkSession, state_path: str, version: int) -> dict[int, int]:
    """Version of each bucket, as one manifest names them."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{state_path}/manifest/v{version:08d}").collect()}


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose folder under ``path`` was written to its end, in order."""
    hpath, fs = hadoop_path(spark, f"{path}/v*/_SUCCESS")
    return sorted(int(x.getPath().getParent().getName()[1:]) for x in fs.globStatus(hpath) or [])


def latest_table(spark: SparkSession, state_path: str) -> DataFrame:
    """The state that the newest manifest names."""
    done = _versions(spark, f"{state_path}/manifest")
    if not done:
        raise FileNotFoundError(f"no merged state under {state_path}")
    return spark.read.parquet(*[_bucket_path(state_path, v, b) for b, v in _manifest(spark, state_path, done[-1]).items()])


def keep_latest_stream(stream: DataFrame, state_path: str, checkpoint: str,
                       id_col: str, date_col: str, tiebreak: str):
    """STR-4: keep the latest row per id as change batches arrive."""
    return (stream.writeStream.foreachBatch(merge_latest(state_path, id_col, date_col, tiebreak))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


__all__: Sequence[str] = ["log_stream", "line_stream", "ingest_lines", "read_ingested", "ingest_with_quarantine", "daily_event_counts",
                          "read_epochs", "run_complete", "run_append", "run_closed", "score_stream", "merge_latest", "latest_table",
                          "keep_latest_stream"]
