"""opsloom: operational-telemetry analytics on Spark DataFrames."""
