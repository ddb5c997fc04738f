"""vecloom: vector collections, metadata filters and nearest-neighbour search on PySpark."""
