"""Registered queries of the signal and spike-train operators."""

from __future__ import annotations

from . import adaptive, signals, streams, trains

QUERIES = {**signals.QUERIES, **trains.QUERIES, **adaptive.QUERIES, **streams.QUERIES}
ORACLES: dict[str, str] = {**signals.ORACLES, **trains.ORACLES, **adaptive.ORACLES, **streams.ORACLES}
