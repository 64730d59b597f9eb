"""Relational operators on read counts, coding positions and diversities."""
