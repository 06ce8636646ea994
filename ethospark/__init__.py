"""Behaviour-series analytics on Spark."""
