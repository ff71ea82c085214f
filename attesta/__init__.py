"""Citation analytics on Spark: typed tables in, DataFrame operators, no session of its own."""
