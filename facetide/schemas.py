"""Table layouts: events on the wire, stored events, legacy events, detections, labels."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_WIRE = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("face_id", T.LongType()),
        T.StructField("producer_ts", T.DoubleType()),
        T.StructField("emotion", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bbox_x", T.IntegerType()),
        T.StructField("bbox_y", T.IntegerType()),
        T.StructField("bbox_w", T.IntegerType()),
        T.StructField("bbox_h", T.IntegerType()),
    ]
)

EVENT_STORED = T.StructType(
    list(EVENT_WIRE.fields)
    + [
        T.StructField("spark_ts", T.TimestampType()),
        T.StructField("producer_ts_sec", T.DoubleType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_minute", T.TimestampType()),
        T.StructField("e2e_latency_ms", T.DoubleType()),
        T.StructField("processing_time_ms", T.DoubleType()),
        T.StructField("event_date", T.DateType()),
    ]
)

EVENT_V1 = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("emotion", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

RAW_MESSAGE = T.StructType(
    [T.StructField("message", T.StringType()), T.StructField("event_time", T.TimestampType())]
)

LABELS = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("label", T.StringType())])

# The eight class names, in class order.
EMOTIONS = ["anger", "contempt", "disgust", "fear", "happiness", "neutral", "sadness", "surprise"]
