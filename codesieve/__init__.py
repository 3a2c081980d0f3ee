"""Security-scan analytics on PySpark DataFrames."""
