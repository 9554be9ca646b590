"""Typed scans, sinks and file layouts."""
