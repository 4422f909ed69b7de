"""Structured Streaming forms of the journal and ledger operators."""
