"""An analytics engine for personal mobility history, on Spark.

``import_history`` and ``import_histories`` read archives into tables,
``write_tables`` writes them as a version and ``read_tables`` reads one, ``Job``
watches and cancels a run, ``scan_folder`` says what a folder holds without
reading it whole and ``scan`` what the values of ``read_archives`` hold,
``register`` makes the functions known to SQL, and ``start`` gives a session
with the settings that all of it assumes.
"""

from __future__ import annotations

import importlib

_API = {
    "import_history": ("chronofold.plans.importer", "import_history"),
    "import_histories": ("chronofold.plans.importer", "import_histories"),
    "write_tables": ("chronofold.plans.sinks", "write_tables"),
    "read_tables": ("chronofold.plans.sinks", "read_tables"),
    "Job": ("chronofold.plans.jobs", "Job"),
    "read_archives": ("chronofold.sources.archive", "read_archives"),
    "scan": ("chronofold.sources.archive", "scan_summary"),
    "scan_folder": ("chronofold.sources.archive", "scan_folder"),
    "register": ("chronofold.functions.register", "register"),
    "start": ("chronofold.session", "session"),
}


def __getattr__(name: str):
    """What the package offers, loaded when it is first asked for."""
    if name not in _API:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, function = _API[name]
    return getattr(importlib.import_module(module), function)
