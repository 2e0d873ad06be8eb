"""Training-data operators: deduplication, filtering, scoring, mixing and placement of a document corpus."""
