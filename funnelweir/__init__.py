"""Funnel-causal analytics as PySpark DataFrame operators and jobs."""
