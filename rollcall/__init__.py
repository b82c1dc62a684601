"""rollcall: event attendance sheets to one clean directory, on Spark DataFrames."""
