"""Named options: strategies, selectors, placement policies, partitioners, arrivals, rate adapters.

Each name gives a callable; one that is not decided gives a callable that raises Undecided with its number.
"""

from __future__ import annotations

from spindrift.operators import distributed as D
from spindrift.operators import placement as M
from spindrift.operators.stores import EpochLog
from spindrift.streaming import arrivals as A
from spindrift.undecided import Undecided


def undecided(ident: str):
    def refuse(*_, **__):
        raise Undecided(ident)

    return refuse


STRATEGIES = {"two-phase": D.two_phase, "two-phase+1": D.two_phase, "local": D.local_strategy, "local-quota": D.local_quota_strategy, "proportional-quota": undecided("U5")}
SELECTORS = {"owner": D.pick_owner, "local": D.pick_entry, "warmup": D.pick_warmup, "outsource": undecided("U6")}
POLICIES = {"even": lambda spark, owners, nodes, ever=None: M.repartition(spark, owners, nodes), "even-reversible": M.repartition, "weighted": undecided("U3")}
PARTITIONERS = {"range": D.range_partitions, "hash": D.hash_partitions, "locality": undecided("U2")}
ARRIVALS = {"poisson": A.poisson, "semdn": undecided("U11")}
RATES = {"fixed": M.fixed_rate, "adaptive": undecided("U8")}
EPOCH_STORES = {"memory": M.EpochStore, "folder": EpochLog, "etcd": undecided("U10")}


def option(kind: dict, name: str):
    if name not in kind:
        raise ValueError(f"{name} is none of {', '.join(kind)}")
    return kind[name]
