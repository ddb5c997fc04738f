"""Operators for preparing training data; nothing else in vecloom imports this subpackage."""
