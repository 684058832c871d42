"""tessera: structural, telemetry and text analytics as Spark DataFrame plans."""
