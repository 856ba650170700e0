"""Readers: the JSON-lines snapshot and the views over the driver's tables."""
