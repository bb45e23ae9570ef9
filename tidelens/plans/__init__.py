"""The query catalogue: name -> (Spark query, DuckDB oracle or None)."""
