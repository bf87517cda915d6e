"""Event analytics and feature engine on PySpark DataFrames."""
