"""emberlog: combat-reading analytics as Spark DataFrame operators."""
