"""Multi-sensor tracking and spatial map queries on Spark."""
