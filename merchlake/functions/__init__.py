"""merchlake: product-listing analytics on Spark DataFrames."""
