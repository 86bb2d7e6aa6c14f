"""seriesloom: preparing, analysing and evaluating large collections of time series on Spark."""
