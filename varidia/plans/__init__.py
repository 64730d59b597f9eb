"""Whole analyses: reports, the derived inputs and the registered queries."""
