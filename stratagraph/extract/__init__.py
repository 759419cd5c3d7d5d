"""Extractors: one source file to nodes, edges and errors."""
