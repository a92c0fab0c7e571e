"""quire: document analytics on PySpark DataFrames."""
