"""Retail star-schema building, checking and reporting as Spark DataFrame operators."""
