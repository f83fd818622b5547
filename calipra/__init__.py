"""Measurement-text analytics on Spark: parse, count, rank, match and compare lines of measurements."""
