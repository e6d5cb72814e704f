"""ledgerloom: a PySpark-native engine for agent transcripts and training-data pipelines."""
