"""Binding of the jobs to the benchmark tables: adapters, queries and SQL oracles."""
