"""Continuous intake of booking requests and cancellations."""
