"""Operators that prepare conversational text for training; nothing outside this package imports them."""
