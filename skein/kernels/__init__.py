"""Dense NumPy kernels that run inside grouped maps, one bounded group a call."""
