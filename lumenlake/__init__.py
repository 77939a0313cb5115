"""A PySpark-native engine for session-scoped multimodal evidence."""
