"""Readers that give typed rows with an explicit ordinal."""
