"""relevia: search-quality evaluation and training-data preparation as Spark DataFrame operators."""
