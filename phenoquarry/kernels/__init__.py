"""NumPy kernels behind Arrow functions and grouped maps: plain geometry, no geometry library."""
