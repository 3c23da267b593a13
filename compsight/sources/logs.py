"""Append-only JSON-lines logs (SRC-3, SNK-1, SNK-2).

Reading: blank lines and malformed lines are dropped, a missing path gives
an empty frame, records without a timestamp are kept.  ``quarantine=True``
keeps malformed lines in ``_corrupt_record`` instead, for a side table.
Writing: a batch append of records stamped with the UTC ingest time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import strip_space
from ..functions.text import iso_text
from ..session import path_exists

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType,
               quarantine: bool = False) -> DataFrame:
    """SRC-3: JSONL with an explicit schema; no inference pass over the data."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    if quarantine:
        full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        return (spark.read.schema(full).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of every line of a JSONL log; a missing path gives an empty frame."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "line string, file string")
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")))


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` plus ``fault`` (NULL for a record) and ``record``, a struct of ``schema``.

    Faults: ``blank``; ``not an object`` (bare values, lists, plain text); ``malformed``
    (an object that does not parse, or a value that its field's type cannot hold).
    """
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("__r", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    text = strip_space(F.coalesce(F.col("line"), F.lit("")))
    fault = (F.when(text == "", "blank").when(~text.startswith("{"), "not an object")
             .when(F.col("__r").isNull() | F.col(f"__r.{CORRUPT}").isNotNull(), "malformed"))
    return (parsed.withColumn("fault", fault).withColumn("record", F.when(
        F.col("fault").isNull(), F.struct(*[F.col(f"__r.`{f.name}`") for f in schema.fields]))).drop("__r"))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) from a ``quarantine=True`` read."""
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def stamp_records(payload: DataFrame, event: str | None = None,
                  request: Mapping[str, Column | str | None] | None = None, clock: Column | None = None) -> DataFrame:
    """SNK-1/SNK-2 record shape: UTC ingest time (``clock``, else now), event type and request fields
    first, payload columns last (a payload column wins on a name clash)."""
    head: dict[str, Column] = {"timestamp": iso_text(F.current_timestamp() if clock is None else clock)}
    if event is not None:
        head["event"] = F.lit(event)
    for k, v in (request or {}).items():
        head[k] = v if isinstance(v, Column) else F.lit(v).cast("string")
    head = {k: v for k, v in head.items() if k not in payload.columns}
    return payload.select(*[v.alias(k) for k, v in head.items()], *payload.columns)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append records as JSON lines (one writer task per partition)."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """SNK-1/SNK-2: append records under a key; the same epoch again replaces itself, so a retry repeats no record."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/v{epoch:08d}")
