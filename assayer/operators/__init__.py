"""Operator families. ``kernels`` holds the few building blocks the others share."""
