"""Particle-trajectory analytics on Spark: DataFrame operators over atoms, frames and bonds."""
