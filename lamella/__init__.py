"""lamella: a Spark-native engine for document-structure data."""
