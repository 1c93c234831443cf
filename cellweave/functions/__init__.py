"""Functions of pixels and of small arrays, as columns."""
