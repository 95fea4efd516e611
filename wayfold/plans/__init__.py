"""Whole-capture jobs: every derived table from the raw logs."""
