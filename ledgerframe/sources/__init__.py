"""Where datasets come from and go to: Parquet, JDBC and the catalog file."""
