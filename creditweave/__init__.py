"""Cash application and training-data preparation as Spark jobs."""
