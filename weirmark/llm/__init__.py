"""Operators of a training-data pipeline over document and embedding tables.

Nothing else in the library imports this subpackage; its queries are listed in
``weirmark.llm.queries`` and added by ``__spark_entry__`` when it is present.
"""
