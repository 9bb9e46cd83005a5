"""Spark jobs for card-fraud analytics: training sequences, alert root causes, feature catalogs."""
