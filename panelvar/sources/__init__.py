"""Readers, the test-table adapter and the sinks."""
