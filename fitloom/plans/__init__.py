"""Helpers for plans: intermediate tables in shared storage."""
