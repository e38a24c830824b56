"""Market-implied probabilities against forecasts and outcomes, as Spark jobs."""
