"""Structured Streaming forms of the tables that outlive a query."""
