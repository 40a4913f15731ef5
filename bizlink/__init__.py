"""Business-contact tables and training-data preparation as Spark DataFrame operators."""
