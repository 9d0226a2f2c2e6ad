"""Operators of a training-data pipeline: tokenization, quality, licences, HTML, toxicity, near-copies, leaks, URLs, personal data."""
