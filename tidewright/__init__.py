"""Tidewright: sea-passage planning analytics on Spark DataFrames."""
