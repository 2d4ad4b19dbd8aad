"""lexmill: a Spark-native batch engine for versioned document collections and hybrid retrieval."""
