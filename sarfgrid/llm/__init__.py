"""Training-data operators: one module per operator, each with a general interface.

Nothing outside this subpackage imports it.
"""
