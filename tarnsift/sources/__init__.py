"""Readers and writers: flow and per-class CSV files, split tables, run results, file inventories."""
