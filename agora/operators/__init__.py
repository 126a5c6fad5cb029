"""Cleaning, quality and analysis operators (pure DataFrame -> DataFrame)."""
