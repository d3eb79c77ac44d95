"""Item-bank analytics on Spark."""
