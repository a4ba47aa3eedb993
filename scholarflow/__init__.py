"""scholarflow: Spark-native building blocks for corpora of scholarly literature."""
