"""Rasters as tables of pixels, from files and from tables."""
