"""Signal-compression analytics and sequence-data preparation as Spark jobs."""
