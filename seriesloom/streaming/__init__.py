"""Structured Streaming jobs over event streams.

Every function takes and returns a streaming DataFrame (a batch one works
too); state is bounded by watermarks, and results go where the caller
writes them."""
