"""Reset of an adapter: its service's cursor, then the library, then a new fetch, with a report of what was done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tidemark.plans.store import Store


class UnknownAdapter(KeyError):
    """There is no such adapter; nothing was done."""


class HelperFailed(RuntimeError):
    """The adapter's service wasn't reset; the library is as it was."""


@dataclass
class Report:
    """ok is false if the library was reset but nothing will be fetched soon: a partial success, with the reasons."""

    adapter_id: str
    ok: bool = True
    helper_reset: bool | None = None
    cleared: list[str] = field(default_factory=list)
    sources_reset: int = 0
    chunks_retired: int = 0
    triggered: bool = False
    needs_fetch: bool = False
    errors: list[str] = field(default_factory=list)


def reset(store: Store, adapter_id: str, at: str, helper: Callable[[], list[str]] | None = None, trigger: Callable[[str], bool] | None = None) -> tuple[Store, Report]:
    """In this order, each step only after those before it:

    1. the adapter has to be known; 2. its service forgets its cursors (``helper`` returns their names; None: it has no
    service); 3. its chunks are retired and its fetch times forgotten; 4. a fetch is asked for (``trigger``); 5. whether one
    is needed is told by its sources, of which those that are pushed come by themselves; 6. the report.

    What fails in 2 ends the reset before the library is touched. What fails in 4 is in the report: the library stays reset."""
    if store.adapters.where(F.col("adapter_id") == adapter_id).isEmpty():
        raise UnknownAdapter(adapter_id)
    out = Report(adapter_id)
    if helper is not None:
        try:
            out.cleared = list(helper())
        except Exception as e:
            raise HelperFailed(f"{type(e).__name__}: {e}") from e
        out.helper_reset = True
    after, counts = store.reset_adapter(adapter_id, at)
    told = counts.first()
    out.chunks_retired, out.sources_reset = told.chunks_retired, told.sources_reset
    out.needs_fetch = not store.sources.where((F.col("adapter_id") == adapter_id) & (F.col("poll_strategy") != "push")).isEmpty()
    try:
        out.triggered = bool(trigger and trigger(adapter_id))
        if out.needs_fetch and not out.triggered:
            out.errors.append("no fetch was started")
    except Exception as e:  # the library is reset: this is reported, not raised
        out.errors.append(f"{type(e).__name__}: {e}")
    out.ok = not out.errors
    return after, out
