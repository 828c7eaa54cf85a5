"""Compositions of operators: pipelines, models, registered queries."""
