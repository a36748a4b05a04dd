"""Registered queries, their SQL, and estimators."""
