"""newsloom: news-sentiment and market analytics on Spark DataFrames."""
