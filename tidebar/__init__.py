"""Futures bar analytics as DataFrame -> DataFrame operators keyed by symbol and time."""
