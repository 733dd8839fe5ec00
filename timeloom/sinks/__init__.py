"""Writers for merged tables."""
