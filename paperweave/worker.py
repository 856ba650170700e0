"""Objects that the tasks of one Python worker share.

A broadcast travels by plain pickle, which needs an object's class on the
worker. So broadcasts carry bytes, arrays and tuples only; what the tasks make
of them is kept here, for the lifetime of the worker process.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

HELD = 4                     # objects a worker keeps


def new_key() -> str:
    """Names an object; drawn on the driver, sent with the function that makes it."""
    return uuid.uuid4().hex


def shared(key: str, make: Callable[[], Any], slot: str | None = None) -> Any:
    """What ``make`` returns, made once per Python worker. A ``slot`` holds one
    object: the one before goes first, so the models of a job's rounds don't add up. The functions of
    this package travel by value, so the store hangs on a module that every worker has."""
    import pyspark

    held = pyspark.__dict__.setdefault("_paperweave_shared", {})
    if key not in held:
        for old in [k for k, (at, _) in held.items() if slot is not None and at == slot]:
            del held[old]
        while len(held) >= HELD:
            del held[next(iter(held))]
        held[key] = slot, make()
    return held[key][1]
