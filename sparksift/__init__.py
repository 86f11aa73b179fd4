"""sparksift: ranked retrieval and code-graph analytics on PySpark DataFrames."""
