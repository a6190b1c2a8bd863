"""Protobuf messages of the four topics to columns and back.

The schemas are built here from the field tables below. Spark's own Protobuf
functions are used where their jar is present; otherwise an Arrow UDF over
google.protobuf, which must then be installed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ampline.functions.rules import EVENTS
from ampline.operators.batch import CLOSE_REASONS

# Fixed values of the wire contract: topic -> message name and its fields, numbered from 1.
MESSAGES = {
    "vehicle.charging.v1": ("ChargingEvent", ["event_id string", "vin string", "ts bigint", "event enum", "energy_wh bigint", "lat double?", "lon double?", "charger_type string?"]),
    "vehicle.battery.v1": ("BatteryReading", ["event_id string", "vin string", "ts bigint", "soc_pct double?", "soh_pct double?", "cell_temp_max_c double?", "pack_voltage_v double?"]),
    "charging.sessions.v1": ("ChargingSession", ["output_id string", "vin string", "start_ts bigint", "end_ts bigint", "duration_ms bigint", "total_energy_wh bigint", "start_lat double", "start_lon double", "charger_type string", "close_reason enum"]),
    "battery.health.v1": ("BatteryWindow", ["output_id string", "vin string", "window_start bigint", "avg_soc_pct double", "min_soh_pct double", "max_cell_temp_c double", "alert boolean", "event_count bigint"]),
}
ENUMS = {"vehicle.charging.v1": ("ChargingEventType", ("EVENT_UNSPECIFIED", *EVENTS)), "charging.sessions.v1": ("CloseReason", ("CLOSE_REASON_UNSPECIFIED", *CLOSE_REASONS))}


def _fields(topic: str) -> list[tuple[str, str, bool]]:
    split = [f.split(" ") for f in MESSAGES[topic][1]]
    return [(name, kind.rstrip("?"), kind.endswith("?")) for name, kind in split]


def ddl(topic: str) -> str:
    return ", ".join(f"{n} {'string' if k == 'enum' else k}" for n, k, _ in _fields(topic))


def descriptor_set(topic: str) -> bytes:
    """A serialised FileDescriptorSet with the topic's one file."""
    from google.protobuf import descriptor_pb2 as pb

    file = pb.FileDescriptorProto(name=f"{topic}.proto", package=topic, syntax="proto3")
    message = file.message_type.add(name=MESSAGES[topic][0])
    if topic in ENUMS:
        enum = file.enum_type.add(name=ENUMS[topic][0])
        for i, name in enumerate(ENUMS[topic][1]):
            enum.value.add(name=name, number=i)
    kinds = {"string": pb.FieldDescriptorProto.TYPE_STRING, "bigint": pb.FieldDescriptorProto.TYPE_INT64, "double": pb.FieldDescriptorProto.TYPE_DOUBLE, "boolean": pb.FieldDescriptorProto.TYPE_BOOL, "enum": pb.FieldDescriptorProto.TYPE_ENUM}
    for i, (name, kind, optional) in enumerate(_fields(topic), 1):
        field = message.field.add(name=name, number=i, type=kinds[kind], label=pb.FieldDescriptorProto.LABEL_OPTIONAL)
        if kind == "enum":
            field.type_name = f".{topic}.{ENUMS[topic][0]}"
        if optional:
            field.proto3_optional, field.oneof_index = True, len(message.oneof_decl)
            message.oneof_decl.add(name=f"_{name}")
    return pb.FileDescriptorSet(file=[file]).SerializeToString()


def message_class(topic: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set(topic)).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{topic}.{MESSAGES[topic][0]}"))


def _native(spark) -> bool:
    """Whether the JVM has Spark's Protobuf functions."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.protobuf.ProtobufDataToCatalyst")
    except Exception:  # py4j wraps ClassNotFoundException
        return False
    return True


def decode(spark, payload: Column, topic: str) -> Column:
    """A struct of the topic's fields; null where the bytes are not such a message (null payload too).

    Unset optional fields are null, others take their default. An enum number
    without a name becomes the default's name, which no rule accepts.
    """
    if _native(spark):
        from pyspark.sql.protobuf.functions import from_protobuf

        return from_protobuf(payload, f"{topic}.{MESSAGES[topic][0]}", options={"mode": "PERMISSIVE", "emit.default.values": "true"}, binaryDescriptorSet=descriptor_set(topic))
    fields = _fields(topic)

    @F.pandas_udf(ddl(topic))
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from google.protobuf.message import DecodeError

        cls = message_class(topic)
        names = dict(enumerate(ENUMS[topic][1])) if topic in ENUMS else {}
        for batch in batches:
            rows = []
            for data in batch:
                try:
                    if data is None:
                        raise DecodeError
                    m = cls.FromString(bytes(data))
                except DecodeError:
                    rows.append([None] * len(fields))
                    continue
                rows.append([None if optional and not m.HasField(n) else names.get(getattr(m, n), names.get(0)) if kind == "enum" else getattr(m, n) for n, kind, optional in fields])
            frame = pd.DataFrame(rows, columns=[n for n, _, _ in fields], dtype=object)
            yield frame.astype({n: "Int64" for n, kind, _ in fields if kind == "bigint"})

    out = parse(payload)
    return F.when(out[fields[0][0]].isNotNull(), out)  # a message that parses has its first field


def encode(spark, record: Column, topic: str) -> Column:
    """Bytes of a struct that has the topic's fields; nulls are left unset."""
    if _native(spark):
        from pyspark.sql.protobuf.functions import to_protobuf

        return to_protobuf(record, f"{topic}.{MESSAGES[topic][0]}", binaryDescriptorSet=descriptor_set(topic))
    fields = _fields(topic)

    @F.pandas_udf("binary")
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        cls = message_class(topic)
        numbers = {n: i for i, n in enumerate(ENUMS[topic][1])} if topic in ENUMS else {}
        cast = {"bigint": int, "double": float, "boolean": bool, "string": str, "enum": numbers.__getitem__}
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
            yield pd.Series([cls(**{n: cast[kind](r[n]) for n, kind, _ in fields if r[n] is not None}).SerializeToString(deterministic=True) for r in rows], dtype=object)

    return build(F.struct(*[record[n].alias(n) for n, _, _ in fields]))
