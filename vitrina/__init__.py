"""Retail field-execution and sell-out analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or column names) and returns a lazy
DataFrame or Column; nothing is collected inside the library.
"""
