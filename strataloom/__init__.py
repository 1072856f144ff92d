"""Architecture analytics over source-code corpora on PySpark."""
