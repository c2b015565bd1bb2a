"""Sources of the evidence-region engine."""
