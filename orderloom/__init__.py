"""Cohort ranking with point-in-time correctness on Spark: operators, sources, functions, plans, streaming."""
