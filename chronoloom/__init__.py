"""Analytics for append-only session event logs, as Spark DataFrame plans."""
