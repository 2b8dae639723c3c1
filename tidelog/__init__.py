"""tidelog: technological-journal analytics as Spark DataFrame jobs."""
