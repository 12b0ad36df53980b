"""Reads, transactions, maintenance and statistics over a mutation log."""
