"""Play-by-play impact analytics on Spark."""
