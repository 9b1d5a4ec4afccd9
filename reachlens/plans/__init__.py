"""Whole pages: the operators of one screen put together over all accounts."""
