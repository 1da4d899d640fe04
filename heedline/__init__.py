"""heedline: message triage over large archives, as plain Spark DataFrame jobs.

* ``functions``  column expressions (text, hashes, mail dates, gist JSON, payload trees)
* ``operators``  DataFrame -> DataFrame steps (joins, newest-row, pending work, inference)
* ``sources``    landing readers, the Parquet tables and the result sinks
* ``plans``      the composite jobs (sync, analyze, gists, backfill, ...)
* ``streaming``  the incremental form of sync
* ``catalog``    the queries registered for the driver, each with its SQL twin
"""

from heedline.session import configure

__all__ = ["configure"]
