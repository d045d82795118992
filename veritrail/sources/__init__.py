"""Scans and sinks: event XML, CVE JSON, taxonomy, stored tables, models."""
