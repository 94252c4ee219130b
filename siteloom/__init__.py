"""siteloom: a Spark-first engine for site evidence, matched inference and corpus work."""
