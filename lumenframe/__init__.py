"""lumenframe: raw-image dataflow and corpus preparation as plain Spark relations."""
