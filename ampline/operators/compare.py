"""Grading as joins: record and counter parity, duplicates, privacy of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.functions import rules


def differs(a: Column, b: Column, tolerance: float | None = None) -> Column:
    if tolerance is None:
        return ~a.eqNullSafe(b)
    near = F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return ~(near | a.eqNullSafe(b))


def record_diff(golden: DataFrame, actual: DataFrame, key: str = "output_id", tolerances: dict[str, float] | None = None) -> DataFrame:
    """(key, status, fields): status missing, extra or changed; fields lists what changed."""
    cols = [c for c in golden.columns if c != key]
    g = golden.select(F.col(key), F.struct(*cols).alias("g"))
    a = actual.select(F.col(key), F.struct(*cols).alias("a"))
    both = g.join(a, key, "full_outer")
    changed = F.concat_ws(",", *[F.when(differs(F.col(f"g.{c}"), F.col(f"a.{c}"), (tolerances or {}).get(c)), F.lit(c)) for c in cols])
    status = F.when(F.col("a").isNull(), "missing").when(F.col("g").isNull(), "extra").when(changed != "", "changed")
    out = both.select(key, status.alias("status"), F.when(F.col("a").isNotNull() & F.col("g").isNotNull(), changed).otherwise("").alias("fields"))
    return out.filter("status is not null")


def missing(golden: DataFrame, actual: DataFrame, key: str = "output_id") -> DataFrame:
    return golden.join(actual, key, "left_anti").select(key)


def common(golden: DataFrame, actual: DataFrame, key: str = "output_id") -> DataFrame:
    return golden.select(key).intersect(actual.select(key))


def repeated(records: DataFrame, key: str = "output_id") -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def owners(rows: DataFrame) -> DataFrame:
    """event_ids seen under more than one key."""
    return rows.groupBy("event_id").agg(F.countDistinct("key").alias("n_keys")).filter("n_keys > 1")


def counter_diff(golden: DataFrame, actual: DataFrame) -> DataFrame:
    j = golden.select("counter", F.col("n").alias("golden")).join(actual.select("counter", F.col("n").alias("actual")), "counter", "full_outer")
    return j.filter(~F.col("golden").eqNullSafe(F.col("actual")))


def unlisted(df: DataFrame, allowed: tuple[str, ...]) -> list[str]:
    return sorted(set(df.columns) - set(allowed))


def project_allowed(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in allowed])


def coordinate_failures(records: DataFrame, taken: DataFrame) -> DataFrame:
    """Records whose coordinates aren't the rounded ones of the accepted plug-in that opened them."""
    plugs = taken.filter("event = 'PLUG_IN'").select(rules.session_output_id(F.col("event_id")).alias("output_id"), rules.round3(F.col("lat")).alias("lat3"), rules.round3(F.col("lon")).alias("lon3"))
    j = records.join(plugs, "output_id", "left")
    ok = F.col("start_lat").eqNullSafe(F.col("lat3")) & F.col("start_lon").eqNullSafe(F.col("lon3")) & F.col("lat3").isNotNull()
    return j.filter(~ok).select("output_id")


def source_lookup(records: DataFrame, taken: DataFrame) -> DataFrame:
    plugs = taken.filter("event = 'PLUG_IN'").select(rules.session_output_id(F.col("event_id")).alias("output_id"), F.col("event_id").alias("source_event_id"))
    return records.select("output_id").join(plugs, "output_id", "left")


def parity(golden: DataFrame, actual: DataFrame, golden_counters: DataFrame, actual_counters: DataFrame, drained: bool, tolerances: dict[str, float] | None = None) -> dict:
    """Checks in order; a run that isn't drained is refused and nothing more is compared."""
    if not drained:
        return {"status": "REFUSED", "checks": []}
    checks = [
        ("duplicate ids", repeated(actual)), ("records", record_diff(golden, actual, tolerances=tolerances)), ("counters", counter_diff(golden_counters, actual_counters)),
    ]
    out = [{"check": name, "problems": df.count(), "first": [r.asDict() for r in df.limit(5).collect()]} for name, df in checks]
    return {"status": "FAIL" if any(c["problems"] for c in out) else "PASS", "checks": out}
