"""stratum: information-density analytics on PySpark DataFrames."""
