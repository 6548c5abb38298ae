"""Lexiloom: text and agreement analytics expressed as Spark DataFrame plans."""
