"""Isohyet: sensor-network analytics as Spark jobs.

Irregular station readings become clean hourly series, gridded estimates and
short-range rain forecasts, in batch and as a stream.  Every public function
takes and returns DataFrames or Columns.
"""

from isohyet.session import build_session

__all__ = ["build_session"]
