"""Whole runs: configuration to ledger, analysis, sweeps."""
