"""Reconciliation and data quality of hierarchical tables as DataFrame operators."""
