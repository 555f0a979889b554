"""weftline: lazily compiled dataflow pipelines over Spark DataFrames."""
