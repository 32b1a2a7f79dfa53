"""Operators for large collections of training text.  Nothing else in the package imports this one."""
