"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` in
``airgrid.llm.registry`` list what ``__spark_entry__.py`` adds.
"""
