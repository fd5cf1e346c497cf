"""Appointment operations and receivables on Spark DataFrames."""

from apptledger.model import Tables

__all__ = ["Tables"]
