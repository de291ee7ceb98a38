"""Reading Parquet: rows with their positions, footers, and the catalog of tables."""
