"""Query catalogue over the driver's tables."""
