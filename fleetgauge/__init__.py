"""Firmware release-stability analytics as lazy Spark DataFrame functions."""
