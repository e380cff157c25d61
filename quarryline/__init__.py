"""quarryline: a relational graph query engine on PySpark DataFrames."""
