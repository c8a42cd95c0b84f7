"""slidegrid: whole-slide cohort, tile and bag analytics on Spark DataFrames."""
