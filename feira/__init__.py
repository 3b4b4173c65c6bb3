"""Marketplace analytics on Spark DataFrames: cleaning, KPIs and reporting views."""

from feira.session import Intermediates, build_session, configure
from feira.tables import CleanTables, RawTables

__all__ = ["CleanTables", "Intermediates", "RawTables", "build_session", "configure"]
