"""Profiling of wide, labelled tables as distributed DataFrame jobs."""

from labelscope.roles import Roles

__all__ = ["Roles"]
