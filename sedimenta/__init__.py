"""Document-curation analytics as Spark column expressions and plans."""
