"""Part of the netloom engine."""
