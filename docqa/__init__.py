"""Question answering over document collections as Spark DataFrame operators."""
