"""Emotion events, detections, face probabilities and training tables as views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probs import softmax
from ..operators.detections import numbered_faces
from . import ingest

CLASSES = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def camera(number: Column) -> Column:
    return F.concat(F.lit("cam_0"), (number % 4 + 1).cast("string"))


def wire_events(events: DataFrame) -> DataFrame:
    """The ten wire columns and ``arrival``, from the ``events`` table."""
    number = F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = micros / F.lit(1e6)
    kind = F.col("event_type")
    return events.select(
        camera(F.col("user_id")).alias("source_id"),
        number.alias("frame_id"),
        (F.col("user_id") % 3 + 1).alias("face_id"),
        F.when(number % 101 == 0, F.lit(None)).when(number % 97 == 0, seconds * 1000).otherwise(seconds).alias("producer_ts"),
        F.when(number % 5 == 0, F.concat(F.upper(F.substring(kind, 1, 1)), F.expr("substring(event_type, 2)")))
        .otherwise(kind)
        .alias("emotion"),
        F.when(number % 89 != 0, F.least(F.col("value") / 25, F.lit(1.0))).alias("score"),
        (number * 7 % 540).cast("int").alias("bbox_x"),
        (number * 11 % 380).cast("int").alias("bbox_y"),
        (number % 60 + 80).cast("int").alias("bbox_w"),
        (number % 50 + 80).cast("int").alias("bbox_h"),
        F.timestamp_micros(micros + (number % 5000 - 200) * 1000).alias("arrival"),
    )


def emotion_events(spark: SparkSession, folder: str, clamp: bool = True) -> DataFrame:
    """Stored events, enriched with the arrival time of the view."""
    wire = ingest.valid_events(wire_events(table(spark, folder, "events")))
    return ingest.enrich(wire, F.col("arrival"), clamp)


def messages(events: DataFrame) -> DataFrame:
    """The events as raw messages: JSON bytes and the broker's timestamp."""
    wire = wire_events(events)
    fields = [name for name in wire.columns if name != "arrival"]
    return wire.select(F.to_json(F.struct(*fields)).cast("binary").alias("value"), F.col("arrival").alias("timestamp"))


def events_v1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        camera(F.col("user_id")).alias("source_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.col("event_type").alias("emotion"),
        F.least(F.col("value") / 25, F.lit(1.0)).alias("score"),
    )


def detections(spark: SparkSession, folder: str, cameras: int = 1) -> DataFrame:
    """Boxes on frames, from ``lineitem``: one order is one frame."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, folder, "lineitem").select("l_orderkey", *order, "l_discount")
    source = camera(F.col("l_orderkey")) if cameras > 1 else F.lit("cam_01")
    lines = lines.withColumns({"source_id": source, "frame_id": F.col("l_orderkey")})
    part = F.col("l_partkey")
    return numbered_faces(lines, order, name="det_no").select(
        "source_id",
        "frame_id",
        (F.col("frame_id") * F.lit(0.1)).alias("ts"),
        "det_no",
        (part % 200 - 20).cast("int").alias("x"),
        (F.col("l_suppkey") * 3 % 200 - 10).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") + 60).alias("w"),
        (part % 50 + 60).cast("int").alias("h"),
        F.when(part % 50 != 0, F.lit(1.0) - F.col("l_discount") * F.lit(6.0)).alias("conf"),
        F.lit(200).alias("frame_w"),
        F.lit(180).alias("frame_h"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of four cameras, ten per second over all of them, from ``orders``."""
    number = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        camera(number).alias("source_id"), number.alias("frame_id"), (number * F.lit(0.1)).alias("ts")
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Face feature vectors, from ``embeddings``."""
    return table(spark, folder, "embeddings").select(
        F.lit("cam_01").alias("source_id"),
        F.col("label").cast("bigint").alias("track_id"),
        F.col("vec_id").alias("frame_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def face_probs(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of eight classes; every eighth of the 64 features adds to one class."""
    steps = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    logits = F.transform(steps, lambda j: F.lit(10.0) * F.aggregate(steps, F.lit(0.0), lambda total, m: total + F.get("features", m * CLASSES + j)))
    return features(spark, folder).select("source_id", "track_id", "frame_id", softmax(logits).alias("probs"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        (F.col("doc_id") % 5 + 1).cast("int").alias("epoch"),
        F.col("quality").alias("y_true"),
        (1 - F.col("toxic")).alias("y_pred"),
    )


def train_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        (F.col("o_orderkey") % 12 + 1).cast("int").alias("epoch"), (F.col("o_totalprice") / 1e5).alias("loss")
    )
