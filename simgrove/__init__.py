"""Text similarity and hierarchical clustering as Spark DataFrames."""
