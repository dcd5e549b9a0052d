"""Structured Streaming forms of the track, tile and condition operators."""
