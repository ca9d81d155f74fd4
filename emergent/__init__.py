"""emergent: schema-less JSON and telemetry analytics on Apache Spark."""

__version__ = "0.1.0"
