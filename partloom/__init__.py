"""Partloom: a Spark-native engine that turns sparse distributor product rows into complete catalog records with the
origin of every value, and measures the result."""
