"""Registration of queries with their oracles."""

from __future__ import annotations

from voxelith.plans import fixtures as fx

CTES = {"vox": fx.VOX, "svox": fx.SVOX, "dim": fx.DIM, "ext": fx.EXT, "field2": fx.FIELD2, "prob": fx.PROB, "lab": fx.LABELS, "box": fx.BOX}
NEEDS = {"field2": ["vox"], "box": ["vox"]}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named tables and those they need."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    if not wanted:
        return body
    rest = body.removeprefix("WITH ")
    joint = ", " if body.startswith("WITH ") else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(CTES[n] for n in wanted) + joint + rest


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, ctes: str = "", sql: str | None = None, recursive: bool = False):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_ctes(ctes, sql.strip(), recursive)
            return f

        return add
