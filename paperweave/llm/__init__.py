"""Operators for large training-data pipelines: sharding, tokenizer encoding,
near-duplicate detection, language-model scoring, URL filtering, exact
substring removal, secret scanning, decontamination, token counts and quality
rules. Nothing else in the library imports this subpackage."""
