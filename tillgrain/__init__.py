"""Retail sales analytics as Spark jobs: ingest, dashboard, product matrix,
pricing, imputation, forecasting and forecast evaluation."""

__version__ = "0.1.0"
