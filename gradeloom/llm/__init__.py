"""Corpus operators for language-model training data.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` in
``registry`` are what ``__spark_entry__`` adds when the folder is present.
"""
