"""Streaming forms of the series operators; each also runs on a batch where it needs no state of its own."""
