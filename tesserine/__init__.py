"""tesserine: a Spark-native query and object-state engine."""
