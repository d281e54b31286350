"""chronoweave: timeline analytics over whole corpora of recordings, on Spark DataFrames."""
