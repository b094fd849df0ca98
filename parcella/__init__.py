"""parcella: property-transaction analytics written for Spark DataFrames."""
