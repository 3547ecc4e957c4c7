"""Calibration images, logs and corpora as Spark DataFrames."""
