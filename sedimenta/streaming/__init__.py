"""Streaming twins of batch operators: extensions, for sources that grow while they are read."""
