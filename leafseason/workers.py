"""Getting functions to the executors."""

from __future__ import annotations

import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def ship(module: str) -> None:
    """Send a module's functions to the workers by value when they can't import it from PYTHONPATH or their folder."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if not any(p and Path(p).resolve() == ROOT for p in known):
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[module])
