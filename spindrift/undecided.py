"""Errors of the engine, and the registry of options that are deliberately open: using one raises, none is guessed."""

from __future__ import annotations


class EngineError(RuntimeError):
    """Base of what an operation can be refused for."""


class NotResident(EngineError):
    """A probed list is not held by the node."""


class NoGraph(EngineError):
    """The node has no heads to navigate."""


class PQAbsent(EngineError):
    """A code is missing."""


class PQFull(EngineError):
    """No room for new codes; nothing was changed."""


class RawAbsent(EngineError):
    """A raw vector is missing and has no source."""


class Unavailable(EngineError):
    """Admission is paused."""


OPEN = {
    "U1": "payload of a partition file beyond lists and locations",
    "U2": "policy that assigns lists to partitions",
    "U3": "weighted placement",
    "U4": "when to rescale",
    "U5": "proportional quota strategy",
    "U6": "outsourced aggregators",
    "U7": "sub-queries of an epoch that has passed",
    "U8": "adaptive transfer rate",
    "U9": "replication of partitions",
    "U10": "external epoch store",
    "U11": "self-similar arrivals",
    "U12": "navigation graph beyond one node",
    "U13": "failure after an epoch was installed",
    "U14": "updates of the vectors",
    "U15": "admission control",
    "U16": "device placement of codes",
}


class Undecided(EngineError):
    def __init__(self, ident: str):
        super().__init__(f"{ident}: {OPEN[ident]} is not decided")
        self.ident = ident
