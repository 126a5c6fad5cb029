"""Declared schemas, readers, the test-data binding and sinks."""
