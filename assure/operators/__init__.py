"""Operators on canonical tables: linking passes, units, checks, triage, constraints."""
