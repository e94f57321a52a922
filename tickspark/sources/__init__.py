"""Tick shards, tick tables, trade ledgers, and what is written back."""
