"""Settings: defaults with a TOML file of one's own laid over them."""

from __future__ import annotations

import copy
import os
import tomllib
from pathlib import Path

from recollect.functions import scoring
from recollect.operators import briefs, budget, retrieval

DEFAULTS: dict = {
    "brief": {"global_budget": briefs.GLOBAL, "project_budget": briefs.PROJECT, "recall_budget": briefs.RECALL, "spine_share": budget.SPINE_SHARE, "directory_share": budget.DIRECTORY_SHARE, "decay": budget.DECAY, "next_cap": budget.NEXT_CAP},
    "retrieval": {"rrf_k": retrieval.RRF_K, "max_hits": retrieval.MAX_HITS, "candidates": retrieval.CANDIDATES},
    "formulas": dict(scoring.FORMULAS),
    "source_priors": dict(scoring.SOURCE_PRIORS),
    "sync": {"settle_hours": 3.0},
}
#: Settings that are shares of a whole.
SHARES = {"spine_share", "directory_share", "decay"}


def load(path: str | None = None) -> dict:
    """The settings; a file may change any default but add none.

    Raises ValueError for unknown keys, values of another kind, numbers that are
    negative, shares above 1, and formulas that do not parse.
    """
    out = copy.deepcopy(DEFAULTS)
    if path is not None:
        with open(path, "rb") as file:
            _overlay(out, tomllib.load(file), "")
    for section in ("brief", "retrieval", "source_priors", "sync"):
        for key, value in out[section].items():
            if value < 0 or (key in SHARES or section == "source_priors") and value > 1:
                raise ValueError(f"{section}.{key} is out of range: {value}")
    for source in out["formulas"].values():
        scoring.parsed(source)
    return out


def _overlay(base: dict, own: dict, where: str) -> None:
    for key, value in own.items():
        name = f"{where}{key}"
        if key not in base:
            raise ValueError(f"unknown setting {name}")
        if isinstance(base[key], dict) != isinstance(value, dict) or isinstance(base[key], str) != isinstance(value, str) or isinstance(value, bool):
            raise ValueError(f"{name} is of another kind")
        if isinstance(value, dict):
            _overlay(base[key], value, f"{name}.")
        else:
            base[key] = value


def folder_path(path: str, base: str = ".") -> str:
    """An absolute path without links; ``~`` is the home, relative ones start at ``base``."""
    return os.path.realpath(Path(base) / Path(path).expanduser())
