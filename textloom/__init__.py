"""textloom: relational and text operators for document corpora and their event logs, on Spark."""
