"""Vector analytics on PySpark DataFrames: exact and inverted-file nearest neighbour search."""
