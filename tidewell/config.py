"""Sensor, pipeline and model settings: defaults as dataclasses, overridable from YAML files of the same keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


def load_yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


@dataclass(frozen=True)
class Sensors:
    """Channels, rates (Hz) and classes of a capture; the frame has strain, sound and motion channels in this order."""

    rates: dict[str, float] = field(default_factory=lambda: {"strain": 82.0, "imu": 416.0, "mic": 8000.0})
    bend: tuple[str, ...] = ("radial_N", "radial_E", "radial_S", "radial_W")
    stretch: tuple[str, ...] = ("arc_inner_E", "arc_outer_E", "arc_inner_W", "arc_outer_W")
    mic: tuple[str, ...] = ("mic_L", "mic_R")
    mic_active: tuple[str, ...] = ("mic_L",)
    imu: tuple[str, ...] = ("acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z")
    scale: str = "scale_g"
    classes: tuple[str, ...] = ("silence", "suck", "swallow")

    @property
    def strain(self) -> tuple[str, ...]:
        return self.bend + self.stretch

    @property
    def frame(self) -> tuple[str, ...]:
        return self.strain + self.mic + self.imu

    @property
    def inactive(self) -> tuple[str, ...]:
        """Sound channels that keep their place in the frame without a signal."""
        return tuple(c for c in self.mic if c not in self.mic_active)

    @classmethod
    def from_yaml(cls, path: str) -> Sensors:
        y = load_yaml(path)
        names = lambda rows: tuple(r["name"] for r in rows)
        mic = tuple(y["mic"]["channels"])
        return cls(
            rates={k: float(v) for k, v in y["sample_rates_hz"].items()}, bend=names(y["strain"]["bend"]), stretch=names(y["strain"]["stretch"]), mic=mic, mic_active=tuple(y["mic"].get("active_channels", mic)),
            imu=tuple(y["imu"]["accel_channels"]) + tuple(y["imu"]["gyro_channels"]), scale=y["scale"]["channel"], classes=tuple(y.get("classes", cls.classes)),
        )


@dataclass(frozen=True)
class Pipeline:
    """Grid, drift removal, quality limits and windows of session processing."""

    grid_hz: float = 200.0
    alpha: float = 0.001
    seed_s: float = 2.0
    max_nan: float = 0.02
    max_dropout_ms: float = 250.0
    window_s: float = 2.0
    overlap: float = 0.5

    @property
    def hop_s(self) -> float:
        return self.window_s * (1 - self.overlap)

    @property
    def window_rows(self) -> int:
        return round(self.window_s * self.grid_hz)

    @property
    def hop_rows(self) -> int:
        return round(self.hop_s * self.grid_hz)

    @property
    def correction(self) -> float:
        return self.hop_s / self.window_s

    @classmethod
    def from_yaml(cls, path: str) -> Pipeline:
        y = load_yaml(path)
        drift, q, w = y["calibration"]["drift"], y["quality"], y["windowing"]
        return cls(float(y["resampling"]["target_grid_hz"]), float(drift["alpha"]), float(drift["baseline_window_s"]), float(q["max_nan_fraction"]), float(q["max_dropout_ms"]), float(w["window_s"]), float(w["overlap"]))


@dataclass(frozen=True)
class Network:
    """Sizes of the sequence model."""

    channels: int = 16
    filters: tuple[int, ...] = (32, 64, 64)
    kernel: int = 5
    embedding: int = 128
    hand: int = 130
    fusion: int = 128
    hidden: int = 128
    layers: int = 2
    classes: int = 3
    dropout: float = 0.2

    @classmethod
    def from_yaml(cls, path: str) -> Network:
        m = load_yaml(path)["model"]
        c, r = m["cnn"], m["lstm"]
        return cls(c["in_channels"], tuple(c["channels"]), c["kernel_size"], c["embedding_dim"], m["hand_feature_dim"], m["fusion_dim"], r["hidden_size"], r["num_layers"], m["heads"]["num_classes"], float(r.get("dropout", 0.0)))
