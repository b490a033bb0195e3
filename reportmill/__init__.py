"""Report-triage analytics on Spark DataFrames."""
