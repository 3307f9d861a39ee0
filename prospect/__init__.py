"""Pattern mining, kernels and corpus preparation on Spark DataFrames."""
