"""Bars over streams of ticks."""
