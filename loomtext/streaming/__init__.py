"""Streaming use of the plans."""
