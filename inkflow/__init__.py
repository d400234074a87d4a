"""inkflow: Spark-first processing of picture archives and of text corpora."""
