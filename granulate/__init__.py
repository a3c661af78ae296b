"""granulate: Spark-native analytics for particle-image metrology and curation tables.

Every operator takes DataFrames (or Columns) and returns them; nothing is
collected unless its size is bounded by the schema or a stated parameter.
"""
