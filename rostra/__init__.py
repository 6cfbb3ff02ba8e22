"""Rostra: civic-records analytics on PySpark."""
