"""One entry per operator: the Spark query over the test tables and, where SQL can express it, its check in SQL."""

from larder.registry import (  # noqa: F401
    behavior,
    edges,
    extended,
    forecast,
    history,
    inventory,
    invariants,
    menu,
    models,
    profiles,
    roundtrips,
    streams,
)
from larder.registry.base import ENTRIES  # noqa: F401
