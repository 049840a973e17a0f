"""Readers and writers of the formats that entity data comes in."""
