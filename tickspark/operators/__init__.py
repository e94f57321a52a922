"""Validation, metrics, predicates, entry engines and the trade ledger."""
