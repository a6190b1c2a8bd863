"""Event-time telemetry analytics, expressed as Spark DataFrame plans."""
