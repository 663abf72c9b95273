"""Reconciliation of gene trees with species trees, networks and corpus preparation on Spark DataFrames."""
