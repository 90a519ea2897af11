"""Millrace: a PySpark-native analytics engine built around a few parallel second-order operators."""
