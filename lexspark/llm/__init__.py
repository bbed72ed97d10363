"""Operators of training-data pipelines; nothing else in lexspark imports them."""
