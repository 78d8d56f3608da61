"""Calibrated surprise over many streams of observations, as Spark jobs."""
