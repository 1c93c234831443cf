"""Tiles that arrive as a stream."""
