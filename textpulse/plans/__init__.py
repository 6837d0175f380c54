"""Models composed of operators."""
