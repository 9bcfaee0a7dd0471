"""Spark jobs for server-log events, rule detection and log analytics."""
