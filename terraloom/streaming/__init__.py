"""Streaming forms of the mergeable aggregates; an extension of this library, tested against the batch forms."""
