"""Tidemark: operational analytics and text knowledge as Spark DataFrame operators."""
