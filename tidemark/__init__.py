"""tidemark: time-bucketed set analytics on PySpark."""
