"""Spark-native structural analytics: windows, signatures, dilution, retrieval, gating, calibration."""

__version__ = "0.1.0"
