"""Spark-native generation, point-in-time features and audits for simulated CRM data."""
