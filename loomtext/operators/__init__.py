"""Cleaning, chunking, ranking, vectors, extraction, graphs and retrieval."""
