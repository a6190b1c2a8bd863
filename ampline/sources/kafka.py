"""Kafka source and sink, configured from the environment. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators.batch import BATTERY, JobSpec
from ampline.sources import codec
from ampline.sources.fixtures import VALID
from ampline.streaming.listener import LateRows
from ampline.streaming.stateful import facts_stream, session_records, window_records


#: Setting (fixed names and defaults): field, kind, default, least value. A text default of None is filled from the job.
SETTINGS = {
    "KAFKA_BROKER": ("broker", str, "localhost:9092", None),
    "INPUT_TOPIC": ("input_topic", str, None, None),
    "OUTPUT_TOPIC": ("output_topic", str, None, None),
    "GROUP_ID": ("group_id", str, None, None),
    "INPUT_PARTITION": ("partition", int, 0, 0),
    "BATCH_MAX_EVENTS": ("batch_max_events", int, 500, 1),
    "BATCH_POLL_TIMEOUT_MS": ("batch_poll_timeout_ms", int, 1000, 1),
}


def _problem(name: str, kind: type, least: int | None, text: str) -> str | None:
    """What is wrong with a setting's text."""
    if not text:
        return f"{name} has no value"
    if kind is int and not text.removeprefix("-").isdecimal():
        return f"{name}={text} is not a whole number"
    if least is not None and int(text) < least:
        return f"{name}={text} is below {least}"
    return None


@dataclass(frozen=True)
class KafkaConfig:
    broker: str
    input_topic: str
    output_topic: str
    group_id: str
    partition: int
    batch_max_events: int
    batch_poll_timeout_ms: int

    @classmethod
    def read(cls, values: Mapping[str, str], spec: JobSpec | None = None, shadow: bool = False) -> KafkaConfig:
        """Settings from `values`; topics and group default to the job's, the output to its .shadow topic where asked.

        ValueError with all problems, not only the first.
        """
        own = {"input_topic": spec.input_topic, "output_topic": spec.output_topic + (".shadow" if shadow else ""), "group_id": spec.name} if spec else {}
        texts = {name: values.get(name, str(own.get(field, "") if default is None else default)) or str(own.get(field, "")) for name, (field, _, default, _) in SETTINGS.items()}
        bad = [p for name, (_, kind, _, least) in SETTINGS.items() if (p := _problem(name, kind, least, texts[name]))]
        if bad:
            raise ValueError("; ".join(bad))
        return cls(**{field: kind(texts[name]) for name, (field, kind, _, _) in SETTINGS.items()})

    def source_options(self) -> dict[str, str]:
        """One assigned partition from its beginning; a restart goes on from the checkpoint."""
        return {
            "kafka.bootstrap.servers": self.broker, "assign": f'{{"{self.input_topic}":[{self.partition}]}}', "startingOffsets": "earliest",
            "maxOffsetsPerTrigger": str(self.batch_max_events), "kafka.group.id": self.group_id, "failOnDataLoss": "true",
        }


def messages(raw: DataFrame, spec: JobSpec) -> DataFrame:
    """raw(offset, value) -> rows of the jobs. Bytes that do not decode are invalid rows."""
    decoded = raw.select(F.col("offset").alias("arrival_seq"), codec.decode(raw.sparkSession, F.col("value"), spec.input_topic).alias("m"))
    rows = decoded.select("arrival_seq", "m.*").withColumn("valid", VALID[spec.name]())
    return rules.default_fill(rows).withColumnRenamed("vin", "key").withColumn("batch", F.lit(0).cast("bigint"))


def records(facts: DataFrame, spec: JobSpec) -> DataFrame:
    return window_records(facts, spec) if spec.name == BATTERY.name else session_records(facts)


def encoded(records: DataFrame, spec: JobSpec) -> DataFrame:
    """(key, value): the VIN, and the record's bytes."""
    body = F.struct(*records.columns)
    return records.select(F.col("vin").cast("binary").alias("key"), codec.encode(records.sparkSession, body, spec.output_topic).alias("value"))


def count_facts(facts: DataFrame) -> dict[str, int]:
    """Counters that a micro-batch's facts carry; sessions count by their close reason."""
    reason = F.concat(F.lit("sessions_by_close_reason."), F.lower("close_reason"))
    name = F.when(F.col("kind") == "counter", F.col("counter")).when((F.col("kind") == "record") & F.col("close_reason").isNotNull(), reason)
    return {r["counter"]: r["n"] for r in facts.select(name.alias("counter")).filter("counter is not null").groupBy("counter").agg(F.count(F.lit(1)).alias("n")).collect()}


class CounterFile:
    """Running totals, written anew after every micro-batch and with the rows that the engine dropped as late."""

    def __init__(self, spark: SparkSession, path: str, late: LateRows | None = None):
        self.spark, self.path, self.late, self.totals, self.seen = spark, path, late, {}, -1

    def add(self, facts: DataFrame, batch_id: int) -> None:
        if batch_id <= self.seen:  # a micro-batch that runs again counts once
            return
        for name, n in count_facts(facts).items():
            self.totals[name] = self.totals.get(name, 0) + n
        self.seen = batch_id
        self.write()

    def write(self) -> None:
        dropped = sum(self.late.dropped.values()) if self.late else 0
        body = self.totals | ({"late": self.totals.get("late", 0) + dropped} if dropped else {})
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        out = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
        out.write(bytearray(json.dumps(dict(sorted(body.items()))) + "\n", "utf-8"))
        out.close()


def start(spark: SparkSession, spec: JobSpec, config: KafkaConfig, checkpoint: str, counters: str | None = None):
    """The running query. Records are written at least once; state and offsets are in the checkpoint.

    With `counters`, a path, the totals are written there after each micro-batch.
    """
    raw = spark.readStream.format("kafka").options(**config.source_options()).load().select("offset", "value")

    late = LateRows()
    spark.streams.addListener(late)
    totals = CounterFile(spark, counters, late) if counters else None

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        out = encoded(records(batch, spec), spec)
        out.write.format("kafka").option("kafka.bootstrap.servers", config.broker).option("topic", config.output_topic).save()
        if totals:
            totals.add(batch, batch_id)
        batch.unpersist()

    trigger = {"processingTime": f"{config.batch_poll_timeout_ms} milliseconds"}
    return facts_stream(messages(raw, spec), spec).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**trigger).queryName(spec.name).start()
