"""Model training and scoring with Spark ML (no driver-side data)."""
