"""Release-catalogue analytics on Spark."""
