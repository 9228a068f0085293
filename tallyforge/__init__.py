"""A PySpark-native engine for evidence-gated analysis of program facts."""
