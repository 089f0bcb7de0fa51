"""One module a query: query(spark, sf_dir) and ORACLE_SQL (None where SQL cannot express it)."""
