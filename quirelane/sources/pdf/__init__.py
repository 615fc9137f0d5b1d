"""PDF files as tables: a tolerant pure-Python parser that runs inside Arrow batches."""
