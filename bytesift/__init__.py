"""Byte-precise text scanning, prefix filters and CSV parsing on Spark DataFrames."""
