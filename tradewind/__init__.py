"""Marketplace order analytics as PySpark jobs: ingest, monthly loads, marts, checks, KPIs."""
