"""Disclosure-risk analytics as Spark jobs.

Every public function takes and returns DataFrames (or Columns) and is lazy.
"""
