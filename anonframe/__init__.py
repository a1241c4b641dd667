"""anonframe: federated, k-anonymous analytics on Spark DataFrames."""
