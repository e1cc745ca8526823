"""Stepmill: step-ranking data preparation and scoring as Spark plans.

The subpackages: ``functions`` (Column in, Column out), ``operators``
(DataFrame in, DataFrame out), ``sources`` (readers and writers), ``plans``
(the registered queries and their SQL) and ``streaming`` (the incremental
forms).  ``llm`` holds the operators for training text; nothing outside it
imports it.
"""
