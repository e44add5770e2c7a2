"""Query plans by topic. Importing a topic module registers its queries."""

from __future__ import annotations

import importlib

TOPICS = (
    "scans", "normalize", "calendar_rules", "gates", "joins", "address", "search", "metrics", "windows",
    "selection", "entity", "pages", "maintenance", "monitoring", "streams",
)


def load_all() -> None:
    for topic in TOPICS:
        importlib.import_module(f"{__name__}.{topic}")
