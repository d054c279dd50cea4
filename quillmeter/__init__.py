"""Token economics for language-model context, on Spark DataFrames."""
