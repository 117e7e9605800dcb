"""Intermediate tables in the shared folder; see :mod:`weftline.operators.scratch`."""

from weftline.operators.scratch import Scratch, eager

__all__ = ["Scratch", "eager"]
