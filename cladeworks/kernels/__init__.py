"""Numerical kernels. They take and give numpy arrays, know nothing of Spark, and are called from Arrow maps."""
