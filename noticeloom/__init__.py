"""Recall-notice analytics and corpus preparation as Spark DataFrame operators."""
