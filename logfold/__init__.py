"""logfold: recordings of messages, and the text they carry, as Spark DataFrames."""
