"""Registered queries of the analytics operators, and the SQL that says the same."""

from . import q_bars, q_evaluate, q_ingest, q_network, q_news, q_options, q_readout, q_streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
