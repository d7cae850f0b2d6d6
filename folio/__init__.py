"""folio: analytics over ordered documents, on Spark DataFrames."""
