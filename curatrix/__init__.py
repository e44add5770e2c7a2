"""Curatrix: Spark operators for curating event listings gathered from many sources.

Every operator takes and returns DataFrames (or Columns); nothing reads the wall
clock, and nothing collects data rows to the driver.
"""

__version__ = "0.1.0"
