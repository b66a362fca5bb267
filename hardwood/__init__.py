"""Point-in-time sports-market analytics on Spark."""
