"""Incident-demand and staging analytics as Spark DataFrame operators."""
