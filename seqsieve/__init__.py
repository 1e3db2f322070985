"""seqsieve: a Spark-first engine that sieves ordered draw sequences for reproducible structure."""
