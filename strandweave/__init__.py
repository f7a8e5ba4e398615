"""Mixed-population sequence analysis on Spark."""
