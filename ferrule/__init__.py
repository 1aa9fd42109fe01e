"""ferrule: symbolic regression and corpus preparation on Spark DataFrames."""
