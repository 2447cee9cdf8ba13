"""Settings from the environment, and the test set that they name."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: What the names of the variables begin with.
PREFIX = "PROPGRAPH_"
#: The names looked for where no test set is given, in this order.
CANDIDATES = ("test_set.csv", "test_set.json")


@dataclass(frozen=True)
class Settings:
    model_path: str | None = None
    document_path: str | None = None
    test_set_path: str | None = None
    model: str = "unknown"
    setting: str = "cypher_strict"
    max_context_chars: int = 100_000

    @classmethod
    def of(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings of an environment (the process's own by default); blank values count as not set."""
        env = os.environ if env is None else env
        given = {k: v for k in cls.__dataclass_fields__ if (v := env.get(PREFIX + k.upper(), "").strip())}
        if "max_context_chars" in given:
            return cls(**(given | {"max_context_chars": int(given["max_context_chars"])}))  # type: ignore[arg-type]
        return cls(**given)  # type: ignore[arg-type]


def default_test_set(explicit: str | None, folder: str) -> str | None:
    """The given path if it is a file, else the first of the usual names in a folder, else none."""
    paths = [explicit.strip()] if explicit and explicit.strip() else []
    return next((p for p in (*paths, *(os.path.join(folder, name) for name in CANDIDATES)) if os.path.isfile(p)), None)
