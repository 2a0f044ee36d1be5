"""The query catalogue: name -> (spark, data directory) -> DataFrame, and the SQL that gives the same rows."""
