"""Operators of a training-data pipeline.

Each operator is a module of its own; :mod:`lexiloom.llm.queries` registers
one query per operator.  Nothing outside this package imports it.
"""
