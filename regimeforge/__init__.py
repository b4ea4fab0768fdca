"""Market-state analytics over time-ordered bars, as PySpark DataFrame programs."""
