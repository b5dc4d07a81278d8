"""Small-area accessibility analytics on Spark DataFrames."""
