"""rollmark: record-resolution analytics as Spark DataFrame transformations."""
