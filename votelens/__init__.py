"""votelens: Spark-native analytics over annotator votes, curated labels and rare-event scores."""
