"""Options of an abstraction run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

_RANGES = {"palette_size": (4, 9), "detail": (0, 1), "paper": (0, 1), "paper_density": (0.25, 4), "grain_overlay": (0, 1), "gradient_strength": (0, 1), "min_negative_gap": (0, 0.08), "max_shapes": (3, 30), "curve_smoothing": (0, 1)}
_CHOICES = {"paper_style": ("grain", "rough"), "color_mode": ("source", "balanced", "curated-night"), "archetype": ("auto", "general", "night-landscape")}


@dataclass(frozen=True)
class Options:
    width: int = 1600
    palette_size: int = 6
    detail: float = 0.28
    paper: float = 0.34
    paper_style: str = "grain"
    paper_density: float = 1.0
    grain_overlay: float = 0.0
    gradient_strength: float = 0.30
    min_negative_gap: float = 0.018
    seed: int = 17
    max_shapes: int = 12
    analysis_size: int = 520
    color_mode: str = "source"
    curve_smoothing: float = 0.82
    archetype: str = "auto"
    points: bool = True

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        for name, values in _CHOICES.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {', '.join(values)}")
        if self.width < 320:
            raise ValueError("width must be at least 320")
        if self.grain_overlay and not (self.paper_style == "rough" and self.paper > 0):
            raise ValueError("grain_overlay needs rough paper")
