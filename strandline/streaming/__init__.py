"""Incremental forms of batch operators; an extension, not needed for any query."""
