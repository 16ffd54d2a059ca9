"""Traffic anomaly and incident analytics as Spark DataFrame transformations."""
