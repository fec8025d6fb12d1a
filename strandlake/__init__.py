"""Strandlake: a PySpark-native analytics engine for annotated sequences and events."""
