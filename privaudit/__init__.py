"""Membership-privacy audits of synthetic tables, on Spark DataFrames."""
