"""Claims-utilization analytics written as Spark DataFrame jobs."""
