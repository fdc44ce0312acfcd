"""Training-data operators: ten building blocks for corpora of any size.

Nothing outside this subpackage imports it.
"""
