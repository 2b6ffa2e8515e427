"""Settings of the detection jobs, clamped to their valid ranges."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectSettings:
    chip_half: int = 320
    overlap: float = 0.5
    proposal_floor: float = 0.02
    nms_iou: float = 0.45
    max_detections: int | None = None
    threshold: float = 0.05
    land_review_radius: float = 32.0
    block: int = 256

    def __post_init__(self):
        object.__setattr__(self, "chip_half", max(8, int(self.chip_half)))
        object.__setattr__(self, "overlap", min(0.95, max(0.0, float(self.overlap))))
        if self.max_detections is not None:
            object.__setattr__(self, "max_detections", max(1, int(self.max_detections)))
