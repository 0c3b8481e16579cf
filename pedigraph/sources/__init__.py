"""Readers: call files, pedigrees, intervals, reference sequence and side tables."""
