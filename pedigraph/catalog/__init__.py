"""Registered queries: every operator run on data that Spark derives from the given tables.

Each module holds ``QUERIES`` (name -> callable(spark, folder)) and ``ORACLE``
(name -> the same result in plain SQL).
"""
