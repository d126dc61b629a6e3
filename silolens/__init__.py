"""Federated analytics and explainability as Spark DataFrame operators."""
