"""Point-in-time analytics on Spark: temporal joins, gap-aware windows, calibration, data-quality rules and alerts."""
