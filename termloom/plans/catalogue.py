"""Every query of the core with its equivalent SQL, by name."""

from __future__ import annotations

from termloom.plans import heavy, oracle, reference, streams

QUERIES = {**reference.QUERIES, **streams.QUERIES, **heavy.QUERIES}
ORACLES = {**oracle.ORACLES, **oracle.STREAMS, **heavy.ORACLES}
