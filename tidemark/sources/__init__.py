"""Scans, payload parsing and table maintenance."""
