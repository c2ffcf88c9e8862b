"""Variants of a feature set, and search along axes that keeps only real gains."""

from __future__ import annotations

from collections.abc import Callable

#: Fixed value: the least gain in the primary score that carries a candidate over.
LEAST_GAIN = 0.0003


def variants(names: list[str], changes: dict[str, tuple[list[str], list[str]]]) -> dict[str, list[str]]:
    """Feature sets by variant name from (added, left out); the order stays, and an unknown name to leave out is an error."""
    out = {}
    for variant, (add, drop) in changes.items():
        unknown = [n for n in drop if n not in names]
        if unknown:
            raise ValueError(f"{variant} leaves out what is not there: {unknown}")
        out[variant] = [n for n in names if n not in drop] + [n for n in add if n not in names]
    return out


def ablations(names: list[str]) -> dict[str, list[str]]:
    """The set without each of its features, under the name of the missing one."""
    return variants(names, {n: ([], [n]) for n in names})


def axis_search(start: dict, axes: dict[str, list], score: Callable[[dict], float], least_gain: float = LEAST_GAIN) -> tuple[dict, list[dict]]:
    """Go through the axes in turn; the best candidate of one is carried only if it gains enough.

    ``score`` runs one evaluation (a Spark job of the caller). Returns the last
    configuration and a record of each evaluation.
    """
    now, value = dict(start), score(dict(start))
    record = [{"axis": None, "value": None, "score": value, "carried": True}]
    for axis, values in axes.items():
        tried = [{"axis": axis, "value": v, "score": score(now | {axis: v}), "carried": False} for v in values if v != now.get(axis)]
        record += tried
        top = max(tried, key=lambda r: r["score"], default=None)
        if top and top["score"] - value >= least_gain:
            top["carried"], value = True, top["score"]
            now[axis] = top["value"]
    return now, record
