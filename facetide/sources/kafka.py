"""Kafka topics as streams or bounded tables. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STARTING_OFFSETS = ("latest", "earliest")


def stream_options(
    bootstrap: str,
    topic: str,
    starting_offsets: str = "latest",
    fail_on_data_loss: bool = False,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    if starting_offsets not in STARTING_OFFSETS and not starting_offsets.lstrip().startswith("{"):
        raise ValueError(f"starting_offsets must be one of {STARTING_OFFSETS} or a JSON offset map")
    options = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_stream(spark: SparkSession, bootstrap: str, topic: str, **choices) -> DataFrame:
    return spark.readStream.format("kafka").options(**stream_options(bootstrap, topic, **choices)).load()


def bounded_options(bootstrap: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "endingOffsets": "latest",
        "failOnDataLoss": "false",
    }


def read_messages(spark: SparkSession, bootstrap: str, topic: str, at_most: int | None = None) -> DataFrame:
    """The topic from its beginning; ``at_most`` n messages if given."""
    messages = spark.read.format("kafka").options(**bounded_options(bootstrap, topic)).load()
    return messages if at_most is None else messages.limit(at_most)
