"""Tidewire: a Spark-native engine for multilingual news and event monitoring."""
