"""Host-telemetry analytics on Spark: extraction, roll-ups, profiling, evaluation and triage."""
