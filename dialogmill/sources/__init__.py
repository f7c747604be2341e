"""Readers of interaction logs and of the calendars."""
