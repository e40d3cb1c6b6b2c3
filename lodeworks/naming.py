"""Names of the helper objects that stand beside a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from enum import Enum

from lodeworks.errors import InvalidInput

POSTGRES_LIMIT, MYSQL_LIMIT, WIDE_LIMIT = 63, 64, 1024
DIGEST = 8


class Helper(Enum):
    """Each kind of helper, by its suffix."""

    STAGING = "__lodeworks_staging"
    OUTGOING = "__lodeworks_old"
    INCOMING = "__lodeworks_new"
    LOG_SCRATCH = "__lodeworks_log"
    DELETE_KEYS = "__lodeworks_del"
    CURRENT = "__current"

    @property
    def reserved(self) -> bool:
        """The current view's suffix is an ordinary word, so it stays free for user tables."""
        return self is not Helper.CURRENT


def helper_name(table: str, kind: Helper, limit: int = WIDE_LIMIT) -> str:
    """table with the helper's suffix, within limit bytes; a table name too long
    for that is cut, and a digest of the full name keeps it distinct."""
    name = table + kind.value
    if len(name.encode()) <= limit:
        return name
    digest = hashlib.md5(name.encode()).hexdigest()[:DIGEST]
    room = max(0, limit - len(kind.value) - DIGEST - 1)
    head = table.encode()[:room].decode(errors="ignore")
    return f"{head}_{digest}{kind.value}"


def is_helper(table: str) -> bool:
    bare = table.rpartition(".")[2]
    return any(bare.endswith(k.value) for k in Helper if k.reserved)


def check_destinations(names: Iterable[str]) -> list[str]:
    """Refuse helper names, two sources for one destination, and a table that
    looks like the helper of another one of the run."""
    seen: set[str] = set()
    out = []
    for name in names:
        if is_helper(name):
            raise InvalidInput(f"{name!r} is a working table of the engine, not one to transfer")
        if name in seen:
            raise InvalidInput(f"two source tables would land on {name!r}; transfer them separately")
        seen.add(name)
        out.append(name)
    for name in out:
        for kind in Helper:
            base = name.removesuffix(kind.value)
            if base != name and base in seen:
                raise InvalidInput(f"{name!r} has the name of a helper of {base!r}; transfer them separately")
    return out
