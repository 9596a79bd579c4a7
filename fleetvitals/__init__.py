"""Spark analytics for database-server telemetry collected from a whole fleet.

``operators``  DataFrame -> DataFrame building blocks (ranking, coverage, joins, ...)
``functions``  column helpers: exact whole-number arithmetic, text and time
``sources``    readers, snapshot schemas, text sink
``plans``      the health reports and the section switches built on the operators
"""

__version__ = "0.1.0"
