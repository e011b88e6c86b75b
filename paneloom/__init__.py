"""Panel analytics on Spark: DataFrame operators for documents, tables and unit-by-period panels."""
