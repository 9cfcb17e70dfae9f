"""ordina: exact ordering of Parquet data on Spark."""
