"""Scans, bindings to the test tables, and sinks."""
