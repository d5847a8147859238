"""Question-and-document corpus engine on PySpark DataFrames."""
