"""Preference data and reward evaluation as Spark jobs.

Sub-packages:

* ``sources``   – scans (CSV drop directories, constitutions, split datasets, literal config tables)
* ``sinks``     – CSV / Parquet / JSON writers with round-trip-safe options
* ``functions`` – Column expressions (text cleaning, parsing, templates, token arrays)
* ``operators`` – DataFrame -> DataFrame operators (ranking, flipping, evaluation, metrics, batch jobs)
* ``plans``     – derived fixtures, the query catalog and broadcast helpers
* ``streaming`` – incremental ingestion of the preference drop directory
"""

__version__ = "0.1.0"
