"""Partitioning strategies: halo blocks, block carries, exact order statistics."""
