"""PySpark-native entity resolution and panel scoring, with a set of corpus operators in ``llm``."""
