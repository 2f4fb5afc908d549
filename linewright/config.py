"""Settings from several layers, and where each came from."""

from __future__ import annotations

from dataclasses import dataclass

# Features and whether they are on by default; words of a mode.
FEATURES = {"compress": True, "convWindow": True, "readEnrichment": True, "editMerge": False, "healEdit": True, "priorInjection": False}
MODES = ("fast", "reactive", "strict")


@dataclass(frozen=True)
class Setting:
    value: object
    source: str


def mode(env: str | None = None, project: dict | None = None, shared: dict | None = None) -> Setting:
    """The mode of the first layer that names one; an unknown word is reactive, none at all strict."""
    for source, word in (("env", env), ("project", (project or {}).get("mode")), ("global", (shared or {}).get("mode"))):
        if word:
            return Setting(word if word in MODES else "reactive", source)
    return Setting("strict", "default")


def features(env: str = "", project: dict | None = None, shared: dict | None = None) -> dict[str, Setting]:
    """Each feature from the first layer that sets it; the environment's are written +name or -name."""
    toggles = {p.strip()[1:]: p.strip()[0] == "+" for p in env.split(",") if p.strip()[:1] in ("+", "-")}
    layers = (("env", toggles), ("project", project or {}), ("global", shared or {}), ("default", FEATURES))
    return {name: next(Setting(layer[name], source) for source, layer in layers if name in layer) for name in FEATURES}
