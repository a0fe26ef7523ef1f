"""Scalar functions as Column expressions."""
from .scalar import *  # noqa: F403
