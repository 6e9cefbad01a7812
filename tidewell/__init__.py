"""tidewell: time-series telemetry analytics as PySpark DataFrame operators."""
