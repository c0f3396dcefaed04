"""Run plans: which statistics to compute, where the results go, and the report."""
