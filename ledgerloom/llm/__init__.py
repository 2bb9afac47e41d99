"""Operators for preparing training data; nothing else in ledgerloom imports this subpackage."""
