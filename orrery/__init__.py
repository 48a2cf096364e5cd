"""Infrastructure-graph analytics on Spark: versioned configuration items and relationships as DataFrames."""
