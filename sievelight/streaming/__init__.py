"""Structured Streaming forms of the windowed, stateful and ledger operators."""
