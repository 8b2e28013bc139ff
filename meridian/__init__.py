"""A semantic metrics layer that compiles metric requests to single lazy Spark DataFrames."""
