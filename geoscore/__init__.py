"""Spatial risk scoring on Spark: plain DataFrame-to-DataFrame functions."""
