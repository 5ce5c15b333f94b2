"""A Spark-native engine for curating, auditing and scoring multilingual question/answer corpora."""
