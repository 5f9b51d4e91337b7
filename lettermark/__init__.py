"""Scholarly-citation analytics as DataFrame -> DataFrame operators on Spark."""

from lettermark.config import Config

__all__ = ["Config"]
