"""Structured Streaming extensions (labelled as such: the batch tables have no event time)."""
