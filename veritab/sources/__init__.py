"""Readers and writers for tables, text lines, reports and the result ledger."""
