"""Document retrieval, question answering and training-data preparation as Spark plans."""
