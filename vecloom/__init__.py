"""A Spark-first analytics engine for records that carry vectors, text and relations."""
