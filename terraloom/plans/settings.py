"""Run settings on the driver: validation, precedence, and the shipped parameter sets."""

from __future__ import annotations

import shutil
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from urllib.request import urlopen

N_BANDS, IGNORE = 19, 255
# Image class to stratum, and the evaluation names.
MAPPING = {8: 0, 14: 1, 12: 2, 13: 3}
CLASS_NAMES = {0: "Grass", 1: "Bush", 2: "Tree", 3: "Other"}
# Class weights of the three shipped parameter sets; a band without one weighs `rest`.
WEIGHT_SETS = {
    "baseline": {"weights": {}, "rest": 1.0, "modify_image_map": False},
    "weights_modified": {"weights": {8: 3.0, 14: 10.0}, "rest": 1.0, "modify_image_map": False},
    "weights_more_modified": {"weights": {8: 5.0, 14: 30.0, 12: 1.0, 13: 1.0}, "rest": 0.5, "modify_image_map": True},
}


def band_weights(name: str, n: int = N_BANDS) -> list[float]:
    s = WEIGHT_SETS[name]
    return [float(s["weights"].get(k, s["rest"])) for k in range(n)]


@dataclass(frozen=True)
class Box:
    x_min: int
    x_max: int
    y_min: int
    y_max: int

    def __post_init__(self):
        if self.x_min > self.x_max or self.y_min > self.y_max:
            raise ValueError("bounding box is not ordered")


def positive(value: float, name: str) -> float:
    if not value > 0:
        raise ValueError(f"{name} must be strictly positive")
    return value


def odd_positive(value: int, name: str) -> int:
    if value <= 0 or value % 2 == 0:
        raise ValueError(f"{name} must be odd and positive")
    return value


def site(latitude: float, longitude: float, first_year: int, last_year: int) -> None:
    if not -90 <= latitude <= 90 or not -180 <= longitude <= 180:
        raise ValueError("latitude or longitude out of range")
    if not 1 <= first_year <= last_year <= 9999:
        raise ValueError("years must be ordered and within 1..9999")


def run_limits(batch: int, workers: int, pixels: int, margin: int) -> None:
    positive(batch, "batch")
    positive(pixels, "pixels")
    if workers < 0 or margin < 0:
        raise ValueError("workers and margin must not be negative")


def pick(*values, fallback=None):
    """The first value that is given: command line, then file, then fallback."""
    return next((v for v in values if v is not None), fallback)


def load_yaml(text: str) -> dict:
    """A settings document; anything but a mapping is an error."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    return found


def reweight_config(found: Mapping) -> tuple[dict[int, float], dict[int, int], int]:
    """(weights, mapping, ignore value) of a settings document."""
    return {int(k): float(v) for k, v in found["weights"].items()}, {int(k): int(v) for k, v in found["mapping"].items()}, int(found.get("ignore", IGNORE))


def config_path(given: str, default: str, experiment: str | None) -> Path:
    """The experiment folder's file of that name, unless another path than the default was given."""
    if experiment and Path(given) == Path(default):
        return Path(experiment) / Path(default).name
    return Path(given)


def inference_settings(template: Mapping, mosaic: str, output: str, name: str, model: str, use_gpu: bool, batch: int, workers: int, pixels: int, margin: int, res: float) -> dict:
    """The inference settings of a template: paths and sizes put in, class probabilities asked for, three bands read."""
    run_limits(batch, workers, pixels, margin)
    image = dict(template["modalities"]["AERIAL_RGBI"]) | {"input_img_path": mosaic, "channels": [1, 2, 3]}
    return dict(template) | {
        "output_path": output, "output_name": name, "output_type": "class_prob", "model_weights": model, "use_gpu": use_gpu, "batch_size": batch,
        "num_worker": workers, "img_pixels_detection": pixels, "margin": margin, "output_px_meters": res, "modalities": dict(template["modalities"]) | {"AERIAL_RGBI": image},
    }


def ensure_file(path: str, label: str, url: str | None = None, download_missing: bool = False, timeout: float = 60.0) -> Path:
    """The file, fetched from its url if it is missing and that is allowed; otherwise a missing one is an error."""
    p = Path(path)
    if not p.exists() and download_missing and url:
        p.parent.mkdir(parents=True, exist_ok=True)
        part = p.with_name(p.name + ".part")  # a broken transfer leaves no file of that name
        with urlopen(url, timeout=timeout) as response, part.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(response, out, 1 << 20)
        part.replace(p)
    return require_file(path, label)


def require_file(path: str, label: str) -> Path:
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"{label}: {path}")
    return p
