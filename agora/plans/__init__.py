"""Join helpers and physical-plan checks."""
