"""Schemas, corpora and the query builder."""
