"""End-to-end plans composed from the operators (expand, search, load)."""
