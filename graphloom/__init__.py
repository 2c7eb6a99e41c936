"""Graph analytics over source code and linked data, as operators on Spark DataFrames."""
