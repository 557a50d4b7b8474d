"""Tidemark: due-diligence analytics expressed as Spark DataFrame operators."""
