"""Topics as sources and sinks, and decoding of their values.

A topic is a Kafka topic, whose values are framed Avro records (a zero byte, a four-byte schema number, the body), or,
without a broker, a folder of Parquet files with the typed record, its key and its place in the order of writes.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import schemas

MAX_OFFSETS = 50_000_000
HEADER = 5
#: Records in a file of a folder topic. What one task wrote is read by several: small records would all lie in one row group, which can't be split.
FILE_RECORDS = 250_000
AVRO_PACKAGE = "org.apache.spark:spark-avro_2.13"

# topic -> wire record
WIRES = {
    schemas.CANDLE_TOPIC: schemas.CANDLE_WIRE,
    schemas.NEWS_TOPIC: schemas.NEWS_WIRE,
    schemas.OBSERVATION_TOPIC: schemas.OBSERVATION_WIRE,
}


def kafka_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_offsets: int = MAX_OFFSETS,
    min_partitions: int | None = None,
) -> DataFrame:
    """Streaming Kafka source from the earliest offset; lost offsets do not end the query.

    `max_offsets` paces the backlog: a first batch over a full topic would otherwise be the topic.
    `min_partitions` splits topic partitions over more tasks than the topic has partitions.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false")
        .option("maxOffsetsPerTrigger", max_offsets)
    )
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return reader.load()


def topic_stream(spark: SparkSession, path: str, topic: str, max_files: int | None = None) -> DataFrame:
    """Streaming source over a topic folder."""
    reader = spark.readStream.schema(schemas.topic_rows(WIRES[topic])).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def topic_table(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """All rows of a topic folder; none if nothing was published yet."""
    schema = schemas.topic_rows(WIRES[topic])
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def avro_schema(wire) -> str:
    """The Avro schema text of a wire record."""
    kinds = {
        "string": "string",
        "double": "double",
        "long": "long",
        "millis": {"type": "long", "logicalType": "timestamp-millis"},
    }
    fields = []
    for name, kind, nullable in wire:
        field = {"name": name, "type": kinds[kind]}
        if nullable:
            field = {"name": name, "type": ["null", kinds[kind]], "default": None}
        fields.append(field)
    return json.dumps({"type": "record", "name": "Record", "fields": fields})


def _need_avro(spark: SparkSession) -> None:
    """Framed records need Spark's Avro package, which a session names when it starts."""
    from pyspark.sql.avro.functions import from_avro

    try:
        probe = spark.range(1).select(F.lit(b"").alias("value"))
        probe.select(from_avro("value", '{"type": "string"}')).schema  # noqa: B018 - plans the expression
    except AnalysisException as missing:
        raise RuntimeError(f"framed records need {AVRO_PACKAGE} of Spark's own version in spark.jars.packages") from missing


def decode_topic(records: DataFrame, topic: str) -> DataFrame:
    """Topic rows to record columns plus ingest_time, source_part, source_offset, raw and reason.

    Rows of a folder topic were written in the order of (source_part, source_offset). A broker keeps the order of a key within one
    partition, by offset alone, and source_part is null. Good rows have a null reason. `raw` is the whole record as it arrived: JSON of a typed one, hex of a frame.
    """
    times = (F.col("timestamp").alias("ingest_time"), F.col("offset").alias("source_offset"))
    if "record" in records.columns:
        times = (times[0], written_part().alias("source_part"), times[1])
        reason = F.when(F.col("record").isNull(), "null_value").alias("reason")
        return records.select(*times, F.to_json("record").alias("raw"), "record.*", reason)
    _need_avro(records.sparkSession)
    from pyspark.sql.avro.functions import from_avro

    wire = WIRES[topic]
    body = F.expr(f"substring(value, {HEADER + 1})")
    decoded = records.select("value", *times).withColumn("d", from_avro(body, avro_schema(wire), {"mode": "PERMISSIVE"}))
    required = [F.col(f"d.`{name}`").isNull() for name, _, nullable in wire if not nullable]
    incomplete = required[0]
    for test in required[1:]:
        incomplete = incomplete | test
    framed = (F.length("value") >= HEADER) & (F.expr("substring(value, 1, 1)") == F.lit(b"\x00"))
    return decoded.select(
        "ingest_time",
        F.lit(None).cast("string").alias("source_part"),
        "source_offset",
        F.hex("value").alias("raw"),
        "d.*",
        F.when(F.col("value").isNull(), "null_value").when(~framed, "bad_frame").when(incomplete, "bad_body").alias("reason"),
    )


def encode_topic(records: DataFrame, topic: str, key: str) -> DataFrame:
    """Records to keyed, framed topic rows (key, value)."""
    _need_avro(records.sparkSession)
    from pyspark.sql.avro.functions import to_avro

    wire = WIRES[topic]
    record = F.struct(*(F.col(name) for name, _, _ in wire))
    frame = F.concat(F.lit(b"\x00\x00\x00\x00\x01"), to_avro(record, avro_schema(wire)))
    return records.select(F.col(key).cast("binary").alias("key"), frame.alias("value"))


def written_part() -> Column:
    """Sorts the partitions of a folder topic's batches as they were published; rows of one are in the order of their offsets."""
    return F.concat_ws(
        " ",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "writer",
        F.lpad(F.col("batch").cast("string"), 19, "0"),
        F.lpad(F.col("partition").cast("string"), 10, "0"),
    )


def publish_files(records: DataFrame, topic: str, key: str, path: str, batch_id: int = 0, writer: str = "main") -> None:
    """Write keyed records to a topic folder; a writer's batch published again replaces the first.

    Rows are written where they are. Each carries its place in the order they were given: the batch's time, its input partition and
    its number there. Which of a key's rows is the last is settled by those who read them.
    """
    wire = WIRES[topic]
    kinds = schemas.record_type(wire)
    record = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))
    records.select(
        F.col(key).cast("string").alias("key"),
        record.alias("record"),
        F.lit(topic).alias("topic"),
        F.lit(writer).alias("writer"),
        F.lit(batch_id).cast("bigint").alias("batch"),
        F.spark_partition_id().alias("partition"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("offset"),
        F.current_timestamp().alias("timestamp"),
    ).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).parquet(f"{path}/{writer}-{batch_id}")


def publish_kafka(records: DataFrame, topic: str, key: str, servers: str) -> None:
    (
        encode_topic(records, topic, key)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
