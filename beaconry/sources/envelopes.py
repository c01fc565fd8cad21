"""Envelope scans: one row per received request, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.constants import BYTES_PER_ITEM, JSON, PROTOBUF
from beaconry.functions.columns import payload_format
from beaconry.schemas import ENVELOPE


def store_envelopes(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """Store envelopes partitioned by signal and payload format, the layout large tables want.

    Each decoder then reads its own folders: a JSON payload is not even scanned by the protobuf
    branch, and the other way round.
    """
    with_format(envelopes).write.mode(mode).partitionBy("signal", "source_format").parquet(path)


def read_envelopes(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """Envelopes stored as parquet; columns and filters reach the scan.

    ``partitioned`` says that ``store_envelopes`` wrote them.
    """
    return spark.read.schema(_schema(partitioned)).parquet(path)


def _schema(partitioned: bool) -> str:
    return f"{ENVELOPE}, source_format string" if partitioned else ENVELOPE


def stream_envelopes(spark: SparkSession, path: str, max_files: int | None = 1000,
                     partitioned: bool = False) -> DataFrame:
    """The same table as a stream; ``max_files`` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(_schema(partitioned))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_raw_files(spark: SparkSession, path: str, headers: DataFrame, stream: bool = False) -> DataFrame:
    """Envelopes from raw request bodies, one file each, joined to a table of headers.

    ``headers`` has one row per file: ``file_name``, ``signal``, ``content_type`` and the
    header columns. The file name without its folder is the batch id. The join moves the bodies
    once, unless the headers are small enough for Spark to broadcast them; where that matters,
    take envelopes in once with this and ``store_envelopes``, and read those from then on.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").load(path).select(
        F.substring_index("path", "/", -1).alias("file_name"),
        F.col("modificationTime").alias("received_at"), F.col("content").alias("payload"))
    joined = files.join(headers, "file_name", "left").withColumnRenamed("file_name", "batch_id")
    columns = [c.split(" ")[0] for c in ENVELOPE.split(", ")]
    return joined.select(*[F.col(c) if c in joined.columns else F.lit(None).cast("string").alias(c)
                           for c in columns])


def with_format(envelopes: DataFrame) -> DataFrame:
    """Add ``source_format`` from the content type."""
    return envelopes.withColumn("source_format", payload_format(F.col("content_type")))


def header_tenant() -> Column:
    """The first tenant header that is present."""
    return F.coalesce(F.col("header_tenant"), F.col("header_tenant_alt"))


def estimated_items(payload: Column, signal: Column | str) -> Column:
    """Item count guessed from the payload size; an empty payload holds none."""
    size = F.octet_length(payload)
    per = F.lit(None).cast("int")
    for name, n in BYTES_PER_ITEM.items():
        per = F.when(F.lit(signal) == name if isinstance(signal, str) else signal == name, F.lit(n)).otherwise(per)
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(size / per))).cast("bigint")


#: White space of JSON.
JSON_SPACE = " \t\r\n"


def is_json_object(text: Column) -> Column:
    """The text parses as JSON and its root is an object."""
    return F.try_parse_json(text).isNotNull() & F.ltrim(text, F.lit(JSON_SPACE)).startswith("{")


def _format(envelopes: DataFrame) -> Column:
    """The stored format (a partition, pruned at the scan), else the one of the content type."""
    return F.col("source_format") if "source_format" in envelopes.columns else payload_format(F.col("content_type"))


def json_branch(envelopes: DataFrame, signal: str) -> DataFrame:
    return envelopes.filter((F.col("signal") == signal) & (_format(envelopes) == JSON))


def proto_branch(envelopes: DataFrame, signal: str) -> DataFrame:
    return envelopes.filter((F.col("signal") == signal) & (_format(envelopes) == PROTOBUF))
