"""cytolake: Spark-native analytics for bisulfite-sequencing methylation data."""
