"""Document-transcription analytics on Spark DataFrames."""
