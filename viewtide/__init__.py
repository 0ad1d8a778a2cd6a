"""Viewing-session analytics as plain PySpark DataFrame transformations."""
