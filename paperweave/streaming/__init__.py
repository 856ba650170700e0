"""Incremental (file-stream) loading."""
