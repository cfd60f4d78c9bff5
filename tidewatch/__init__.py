"""Crowd-signal analytics on Spark."""
