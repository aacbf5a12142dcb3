"""Delimited inputs, derived tables, the dataset registry and the results ledger."""
