"""The candidate scan on arriving call-file text."""
