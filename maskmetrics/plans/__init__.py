"""Whole evaluations, and the queries that are registered with the driver."""
