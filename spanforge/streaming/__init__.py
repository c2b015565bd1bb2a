"""Streaming of the evidence-region engine."""
