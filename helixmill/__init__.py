"""Structural-biology and spectrometry jobs on Spark DataFrames."""
