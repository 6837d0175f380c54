"""Feature calculators over long series tables."""
