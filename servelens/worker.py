"""State of a Python worker process that outlives a single task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any


def per_worker(kind: str, version: Hashable, build: Callable[[], Any]) -> Any:
    """The object that ``build`` made in this worker for the current ``version`` of ``kind``.

    Another version takes its place, so a worker holds one object of a kind however many queries it
    serves. Functions that travel with a job get new globals in every task, so the objects are held
    in a module of their own. For models, vocabularies and bounded caches; never for rows.
    """
    holder = sys.modules.setdefault("servelens_worker_state", types.ModuleType("worker_state"))
    held = holder.__dict__.get(kind)
    if held is None or held[0] != version:
        holder.__dict__.pop(kind, None)
        held = holder.__dict__[kind] = (version, build())
    return held[1]
