"""Operators of the evidence-region engine."""
