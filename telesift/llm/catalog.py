"""Importing this module registers every query of the subpackage."""

from telesift.llm import ann, audit, chat, exact, extract, language, licences, middle, mixing, near, packing, repeats, toxicity  # noqa: F401
from telesift.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
