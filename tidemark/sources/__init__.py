"""Readers, sinks and table upkeep."""
