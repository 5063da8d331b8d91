"""corvane: a PySpark-native engine for directory-style records and large text corpora."""
