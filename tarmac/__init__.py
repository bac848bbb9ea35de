"""Delay analytics over flight records, built on Spark DataFrames."""

from tarmac.session import build_session

__all__ = ["build_session"]
