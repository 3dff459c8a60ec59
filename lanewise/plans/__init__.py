"""Staging, curated and KPI plans, publishing, and the batch runs."""
