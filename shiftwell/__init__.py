"""Table migration and change-data-capture on Spark DataFrames."""
