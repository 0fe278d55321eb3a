"""tidemark: ordered-sequence, feature and evaluation analytics as Spark jobs."""
