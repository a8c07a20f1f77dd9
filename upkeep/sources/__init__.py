"""Readers: raw export grids, settings, and the benchmark-table bindings."""
