"""A code store kept entry by entry, against which the stores' tables are tested."""

from collections import Counter

from spindrift.undecided import PQAbsent, PQFull


class CodeStore:
    """A node's codes by state: live while postings refer to them, else staged while protected, else cached."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.refs: Counter = Counter()
        self.held: dict[int, dict] = {}
        self.installed = self.skipped = self.evicted = 0

    def state(self, i: int) -> str:
        return "live" if self.refs[i] else "staged" if self.held[i]["protected"] else "cached"

    def reserve(self, ids) -> list[int]:
        for i in set(ids) & self.held.keys():
            self.held[i]["protected"] = True
        return sorted(set(ids) - self.held.keys())

    def put(self, codes: dict[int, bytes] | list[tuple[int, bytes]]) -> int:
        items = list(codes.items() if isinstance(codes, dict) else codes)
        new = {}
        for i, c in items:
            if i not in self.held:
                new.setdefault(i, c)
        need = len(new) - (self.capacity - len(self.held))
        if need > 0:
            cached = [i for i in self.held if self.state(i) == "cached"]
            if need > len(cached):
                raise PQFull(f"{need} more codes don't fit")
            for i in cached[:need]:
                del self.held[i]
            self.evicted += need
        for i, c in new.items():
            self.held[i] = {"code": c, "protected": True, "ever": False, "loc": None}
        self.installed += len(new)
        self.skipped += len(items) - len(new)
        return len(new)

    def ref(self, postings: list[tuple[int, int]]) -> None:
        """(id, location) of each posting; all or none."""
        where: dict[int, int] = {}
        for i, loc in postings:
            if i not in self.held:
                raise PQAbsent(f"code {i}")
            if where.setdefault(i, loc) != loc or self.held[i]["loc"] not in (None, loc):
                raise ValueError(f"vector {i} has two locations")
        for i, loc in postings:
            self.refs[i] += 1
            self.held[i] |= {"protected": False, "ever": True, "loc": loc}

    def unref(self, ids) -> None:
        for i in ids:
            self.refs[i] -= 1

    def release_staged(self, ids) -> int:
        gone = 0
        for i in set(ids) & self.held.keys():
            if self.held[i]["protected"] and not self.held[i]["ever"]:
                del self.held[i]
                gone += 1
            else:
                self.held[i]["protected"] = False
        return gone

    def stats(self) -> dict[str, int]:
        n = Counter(self.state(i) for i in self.held)
        return {"resident": len(self.held), **{s: n[s] for s in ("live", "staged", "cached")}, "installed": self.installed, "skipped": self.skipped, "evicted": self.evicted}
