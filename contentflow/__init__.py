"""Content pipelines as Spark jobs: ingest, clean, apply models, render."""
