"""Evidence-retrieval analytics as DataFrame programs on Spark."""
