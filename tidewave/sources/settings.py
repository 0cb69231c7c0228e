"""Settings of a run, from built-in values, a YAML file and a profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What records are processed with; bad values are refused when it is made."""

    # The defaults that records are processed with.
    profile: str = "cpu"
    seed: int = 2026
    data: str = "data/train"
    cache: str = ".cache/records"
    run: str = "runs/latest"
    window_seconds: float = 12.0
    window_stride_seconds: float = 6.0
    max_windows_per_record: int = 240
    max_alignment_lag_seconds: float = 45.0
    channels: int = 32
    steps: int = 128
    vector_expansion: int = 8
    evaluation_folds: int = 5
    frames_per_window: int = 6

    def __post_init__(self) -> None:
        low = {"window_seconds": 0, "window_stride_seconds": 0, "channels": 0, "steps": 0, "frames_per_window": 1}
        wrong = [f"{name} must be over {least}" for name, least in low.items() if getattr(self, name) <= least]
        if self.channels > 256:
            wrong.append("channels must be 256 at most")
        if wrong:
            raise ValueError("; ".join(wrong))

    def computed_with(self) -> dict:
        """The values that a record's windows depend on."""
        return {k: v for k, v in asdict(self).items() if k not in ("profile", "seed", "data", "cache", "run", "evaluation_folds")}


#: What a profile changes.
PROFILES = {"quick": {"frames_per_window": 4}, "cpu": {"frames_per_window": 6}, "competition": {"frames_per_window": 12}}
#: Parallel tasks from which ``auto`` is the largest profile.
LARGE = 64


def load(path: str | Path | None = None, profile: str | None = None, workers: int = 1) -> Settings:
    """Settings of a profile. The file's sections ``paths``, ``common`` and ``profiles`` lie over the built-in
    values; keys that nothing here uses are left out, and a missing file changes nothing."""
    tree: dict = {}
    if path is not None and Path(path).is_file():
        import yaml

        tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if not isinstance(tree, dict):
            raise ValueError(f"{path}: settings must be a mapping")
    profiles = {name: {**PROFILES.get(name, {}), **(tree.get("profiles", {}).get(name) or {})} for name in {**PROFILES, **tree.get("profiles", {})}}
    name = profile or tree.get("profile", Settings.profile)
    if name == "auto":
        name = "competition" if workers >= LARGE else "cpu"
    if name not in profiles:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(profiles))}")
    layers = [{k: v for k, v in tree.items() if k == "seed"}, tree.get("paths", {}), tree.get("common", {}), profiles[name]]
    types = {f.name: type(f.default) for f in fields(Settings)}
    values = {k: types[k](v) for layer in layers for k, v in layer.items() if k in types}
    return Settings(**{**values, "profile": name})


def resolved(root: str | Path, configured: str, given: str | None = None) -> Path:
    path = Path(given or configured)
    return path if path.is_absolute() else Path(root) / path
