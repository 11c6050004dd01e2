"""Structured Streaming jobs over status events, each with a batch twin in operators.status."""
