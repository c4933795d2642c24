"""Spark-native scientific kernels: matrices, short-range particles, grid partitioning and k-mer assembly."""
