"""Operators for preparing training text: dedup, decontamination, scoring, mixing."""
