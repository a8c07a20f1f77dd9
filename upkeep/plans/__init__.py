"""Composed reports and batch jobs."""
