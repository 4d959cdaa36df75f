"""Loomlake: analytics for nested, model-generated records, written for Spark DataFrames."""
