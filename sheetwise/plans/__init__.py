"""Compositions of operators: cleaning runs, analysis documents, dashboards."""
