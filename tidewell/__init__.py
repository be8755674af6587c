"""tidewell: a Spark-native engine for multi-rate sensor recordings, event streams and their evaluation."""
