"""Lumenark: media-library analytics as Spark plans."""
