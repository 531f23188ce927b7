"""codeloom: code-base intelligence and corpus analytics on PySpark DataFrames."""
