"""Training-data operators: text extraction, scoring, filtering, deduplication, search, tokens and mixing.

Nothing outside this package imports it.  Every operator works on whole texts and on every row; what each does with nulls,
empty or very long texts, ties and repeated rows stands in its docstring.
"""
