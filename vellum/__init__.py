"""Document analytics on Spark: Markdown statistics, OCR relations, chunks and job logs."""
