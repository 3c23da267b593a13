"""compsight: property-valuation and loan-sizing analytics as Spark DataFrame jobs.

Layout
------
sources/    readers, writers and test-table stand-ins
functions/  column-expression builders (coercion, text, finance, distributions)
operators/  DataFrame -> DataFrame operators and fit/transform estimators
plans/      compositions (training, audit, admin report) and the query catalog
streaming/  Structured Streaming versions of the log and scoring jobs
"""

__version__ = "0.1.0"
