"""lodewright: structure-activity analytics and record processing on Spark DataFrames."""
