"""Ordered and stateful ingest, each operator as a batch fold and as a stream."""
