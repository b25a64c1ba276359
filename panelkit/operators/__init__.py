"""Bars, panels, factors, functional operators and factor evaluation."""
