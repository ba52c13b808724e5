"""Cohort analytics over large sample-by-feature matrices, as Spark DataFrame jobs."""

from cohortgrid.matrix import Matrix

__all__ = ["Matrix"]
