"""Failed-payment recovery analytics as Spark DataFrame jobs."""
