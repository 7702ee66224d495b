"""meshgrain: weighted-graph upscaling and corpus preparation on PySpark DataFrames."""
