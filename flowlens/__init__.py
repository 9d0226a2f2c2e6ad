"""flowlens: network-flow telemetry analytics as Spark DataFrame operators."""
