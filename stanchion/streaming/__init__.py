"""Stateful twins of the batch operators in operators.dwell."""
