"""Temporal, trust-scored knowledge graphs on Spark."""
