"""What is built from operators: the pipeline, answers from retrieved context, the query catalogue."""
