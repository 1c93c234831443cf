"""Window aggregates, stencils and kernels."""
