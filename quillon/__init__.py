"""quillon: null-aware columnar kernels and analytics plans on Spark."""
