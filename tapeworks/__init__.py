"""Order-book and point-process analytics on Spark."""
