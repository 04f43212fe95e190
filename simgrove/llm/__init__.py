"""Operators for preparing training text: ten operators, their queries and the stages of the corpus pipeline."""
