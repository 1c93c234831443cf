"""Whole computations: several triggers of one raster, tile by tile, and what is done with their results."""
