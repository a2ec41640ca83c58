"""PySpark-native code-dependency-graph engine."""
