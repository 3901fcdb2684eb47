"""Column functions: everything stays inside Spark's code generation."""
from millrace.functions.text import words

__all__ = ["words"]
