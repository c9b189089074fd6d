"""The detectors by name, in the order in which ties of their findings stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from codefacts.detectors import calls, modules, shapes
from codefacts.findings import ordered
from codefacts.storage import saved

#: A further detector is one more function of (facts, options) here.
DETECTORS: dict[str, Callable] = {
    "false_sharing": modules.false_sharing,
    "single_use_chain": calls.single_use_chain,
    "empty_wrapper": calls.empty_wrapper,
    "unreachable_files": modules.unreachable_files,
    "unreachable_functions": calls.unreachable_functions,
    "near_duplicate": shapes.near_duplicate,
    "tramp_data": calls.tramp_data,
    "type_clone": shapes.type_clone,
    "unreaching_test": modules.unreaching_test,
}


def detect(facts, options) -> DataFrame:
    """All findings in their total order. Chains are found once and used twice."""
    paths = calls.chains(facts, options)
    out = None
    for name, detector in DETECTORS.items():
        found = detector(facts, options, paths) if name in ("single_use_chain", "empty_wrapper") else detector(facts, options)
        out = found if out is None else out.unionByName(found)
    # Written before it is sorted: sampling for the sort would run everything twice.
    return ordered(saved(out, "findings"))
