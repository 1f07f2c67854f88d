"""Rule evaluation, event routing and audit analytics as Spark DataFrame jobs."""
