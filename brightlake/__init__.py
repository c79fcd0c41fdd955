"""Exploratory and business analytics as plain DataFrame -> DataFrame functions on Spark."""
