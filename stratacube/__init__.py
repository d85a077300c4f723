"""Space-time data cubes as partitioned Spark DataFrames."""
