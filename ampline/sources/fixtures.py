"""Replay fixtures: one JSON object a line, event lines in arrival order and a flush line at the end.

The format is strict: exact keys, JSON types as declared, no null, arrival
numbers 1, 2, 3, ..., batches 1, 2, 3, ... in order. Lines are parsed as
variants, so that 1, 1.0 and "1" differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators.batch import BATTERY, CHARGING, JobSpec

HOUR = 3_600_000
_EVENT = ["arrival_seq", "batch", "message"]
_FLUSH = ["advance_watermark_to", "batch"]
#: Message fields in wire order; those in OPTIONAL have presence.
FIELDS = {
    CHARGING.name: {"event_id": "string", "vin": "string", "ts": "bigint", "event": "string", "energy_wh": "bigint", "lat": "double", "lon": "double", "charger_type": "string"},
    BATTERY.name: {"event_id": "string", "vin": "string", "ts": "bigint", "soc_pct": "double", "soh_pct": "double", "cell_temp_max_c": "double", "pack_voltage_v": "double"},
}
OPTIONAL = {CHARGING.name: ("lat", "lon", "charger_type"), BATTERY.name: ("soc_pct", "soh_pct", "cell_temp_max_c", "pack_voltage_v")}
VALID = {CHARGING.name: rules.charging_valid, BATTERY.name: rules.battery_valid}
SPECS = {s.name: s for s in (CHARGING, BATTERY)}


@dataclass
class Fixture:
    spec: JobSpec
    rows: DataFrame
    target: int
    flush_batch: int


def _kind(path: str) -> Column:
    """JSON type at path: BIGINT, DECIMAL(...), DOUBLE, STRING, BOOLEAN, VOID (null), OBJECT..., ARRAY...; null if absent."""
    return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))


def _is(path: str, type_: str) -> Column:
    kind = _kind(path)
    if type_ == "double":
        return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return kind == {"bigint": "BIGINT", "string": "STRING"}[type_]


def _line_problem(job: str) -> Column:
    positive = lambda path: rules.always(_is(path, "bigint") & (F.try_variant_get("_v", path, "bigint") >= 1))
    known = F.array(*[F.lit(f) for f in FIELDS[job]])
    flush = F.col("_flush")
    problem = F.when(F.col("_v").isNull() | F.col("_keys").isNull(), "not a JSON object")
    problem = problem.when(flush & (F.array_sort("_keys") != F.array(*map(F.lit, _FLUSH))), "flush line: wrong keys")
    problem = problem.when(~flush & (F.array_sort("_keys") != F.array(*map(F.lit, _EVENT))), "event line: wrong keys")
    problem = problem.when(~positive("$.batch"), "batch is not a positive integer")
    problem = problem.when(flush & ~positive("$.advance_watermark_to"), "advance_watermark_to is not a positive integer")
    problem = problem.when(flush, None)
    problem = problem.when(~positive("$.arrival_seq"), "arrival_seq is not a positive integer")
    message = F.json_object_keys(F.get_json_object("value", "$.message"))
    problem = problem.when(~rules.always(_kind("$.message").startswith("OBJECT")), "the message should be a JSON object")
    problem = problem.when(rules.always(F.size(F.array_except(message, known)) > 0), "message has an unknown key")
    for name, type_ in FIELDS[job].items():
        path = f"$.message.{name}"
        problem = problem.when(_kind(path).isNotNull() & ~rules.always(_is(path, type_)), f"{name} is not a {type_}")
    if job == CHARGING.name:
        event = F.try_variant_get("_v", "$.message.event", "string")
        problem = problem.when(event.isNotNull() & ~event.isin("EVENT_UNSPECIFIED", *rules.EVENTS), "unknown event name")
    return problem


def parse(spark: SparkSession, path: str, job: str) -> DataFrame:
    """Lines of one file: pos (file order), flush, problem (null: none), batch, arrival_seq, target and the message fields."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    seen = raw.select("*", F.try_parse_json("value").alias("_v"), F.json_object_keys("value").alias("_keys"))
    seen = seen.withColumn("_flush", rules.always(F.array_contains("_keys", "advance_watermark_to")))
    at = lambda p, t: F.try_variant_get("_v", p, t)
    return seen.select(
        "pos", F.col("_flush").alias("flush"), _line_problem(job).alias("problem"), at("$.batch", "bigint").alias("batch"), at("$.arrival_seq", "bigint").alias("arrival_seq"), at("$.advance_watermark_to", "bigint").alias("target"),
        *[at(f"$.message.{f}", t).alias(f) for f, t in FIELDS[job].items()],
    )


def _messages(lines: DataFrame, job: str) -> DataFrame:
    events = rules.default_fill(lines.filter("not flush").drop("flush", "problem", "target"))
    return events.withColumn("valid", VALID[job]())


def problems(lines: DataFrame, job: str) -> DataFrame:
    """(problem, pos) of every broken rule; empty for a good fixture.

    Order inside a batch is a window over that batch; order between batches is
    one over a row per batch.
    """
    events = _messages(lines.filter("problem is null"), job)
    within = Window.partitionBy("batch").orderBy("pos")
    broken = events.withColumn("_before", F.lag("arrival_seq").over(within)).filter("arrival_seq <> _before + 1")
    per = events.groupBy("batch").agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi"), F.min("pos").alias("pos"), F.max("pos").alias("end"))
    following = per.select("*", *[F.lag(c).over(Window.orderBy("batch")).alias(f"_{c}") for c in ("batch", "hi", "end")])
    first = F.col("_batch").isNull()
    jump = F.when(first & ((F.col("batch") != 1) | (F.col("lo") != 1)), "batches and arrival_seq start at 1")
    jump = jump.when(F.col("batch") != F.col("_batch") + 1, "batches leave a gap").when((F.col("lo") != F.col("_hi") + 1) | (F.col("pos") <= F.col("_end")), "arrival_seq does not rise by 1 over batches")
    ends = lines.filter("problem is null and flush").agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("target"), F.max("batch").alias("batch"), F.max("pos").alias("pos"))
    total = events.agg(F.max("pos").alias("last"), F.max("batch").alias("top"), F.max(F.when(F.col("valid"), F.col("ts"))).alias("ts"))
    end = F.when(F.col("n") != 1, "not exactly one flush line").when(F.col("last") > F.col("pos"), "the flush line is not last")
    end = end.when(F.col("ts").isNull(), "without a valid event there is no flush target").when(F.col("batch") != F.col("top") + 1, "flush batch is not the last batch + 1").when(F.col("target") != F.col("ts") + HOUR, "flush target is not the largest valid ts + 1 hour")
    found = [
        lines.select("problem", "pos"), broken.select(F.lit("arrival_seq does not rise by 1").alias("problem"), "pos"),
        following.select(jump.alias("problem"), "pos"), ends.join(total).select(end.alias("problem"), "pos"),  # one row each
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter("problem is not null")


def load(spark: SparkSession, path: str, job: str) -> Fixture:
    """The fixture's rows, ready for the jobs; ValueError naming the first problems of a bad one."""
    lines = parse(spark, path, job)
    bad = problems(lines, job).orderBy("pos").limit(5).collect()
    if bad:
        raise ValueError(f"{path}: " + "; ".join(r["problem"] for r in bad))
    flush = lines.filter("flush").first()
    return Fixture(SPECS[job], _messages(lines, job).drop("pos").withColumnRenamed("vin", "key"), flush["target"], flush["batch"])


def write(rows: DataFrame, job: str, path: str) -> None:
    """rows(arrival_seq, batch, vin or key, fields...) as one fixture file in a folder, with its flush line.

    A single file in arrival order is the format; rows of a fixture are few (megabytes).
    """
    named = rows.withColumnRenamed("key", "vin") if "vin" not in rows.columns else rows
    message = F.struct(*[F.col(f).cast(t).alias(f) for f, t in FIELDS[job].items()])
    lines = named.select("arrival_seq", F.to_json(F.struct("arrival_seq", "batch", message.alias("message"))).alias("value"))
    end = named.withColumn("valid", VALID[job]()).agg(F.max(F.when(F.col("valid"), F.col("ts"))).alias("ts"), F.max("batch").alias("b"), F.max("arrival_seq").alias("a"))
    flush = end.select((F.col("a") + 1).alias("arrival_seq"), F.to_json(F.struct((F.col("ts") + HOUR).alias("advance_watermark_to"), (F.col("b") + 1).alias("batch"))).alias("value"))
    lines.unionByName(flush).coalesce(1).sortWithinPartitions("arrival_seq").select("value").write.mode("overwrite").text(path)
