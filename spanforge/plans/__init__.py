"""Plans of the evidence-region engine."""
