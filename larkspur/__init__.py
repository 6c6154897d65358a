"""larkspur: listing, booking and visit-conversion analytics on Spark DataFrames."""
