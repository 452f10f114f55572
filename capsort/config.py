"""Settings of the pipeline and their validation. Values are the defaults of the capture-sorting model."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

#: Evidence kinds in order, with default weights.
WEIGHTS = {"folder": 1.0, "time": 1.0, "sequence": 0.5, "gps": 0.8, "altitude": 0.5, "heading": 0.3, "exposure": 0.3, "visual": 1.0}
LINKS = ("hardlink", "copy", "symlink")


@dataclass(frozen=True)
class QualitySettings:
    minimum_sharpness: float | None = None
    maximum_clipping: float = 0.6
    minimum_long_side: int = 800
    maximum_aspect_ratio: float = 2.2
    duplicate_distance: int = 4
    maximum_blur_fraction: float = 0.4


@dataclass(frozen=True)
class GroupingSettings:
    time_gap: float = 300
    sequence_span: float = 10
    gps_radius: float = 8
    floor_height: float = 2.0
    exposure_span: float = 3
    visual_span: float = 0.25
    maximum_gps_accuracy: float = 30
    maximum_gps_age: float = 120
    max_per_group: int = 150
    min_per_group: int = 20
    threshold: float | None = None
    neighbor_window: int = 60
    visual_neighbors: int = 12
    max_links_per_group: int = 4
    minimum_evidence_coverage: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


@dataclass(frozen=True)
class PlannerSettings:
    overlap: int = 15
    diversity_distance: int = 6
    diversity_heading: float = 15
    diversity_meters: float = 1.0


@dataclass(frozen=True)
class SortRequest:
    overlap: int = 15
    max_per_group: int = 150
    min_per_group: int = 20
    time_gap: float = 300
    group_threshold: float | None = None
    minimum_sharpness: float | None = None
    duplicate_distance: int = 4
    link: str = "hardlink"
    recursive: bool = True
    dry_run: bool = False

    def validate(self) -> SortRequest:
        rules = {
            "overlap": self.overlap >= 0,
            "max_per_group": self.max_per_group >= 10,
            "min_per_group": 1 <= self.min_per_group <= self.max_per_group,
            "duplicate_distance": 0 <= self.duplicate_distance <= 64,
            "group_threshold": self.group_threshold is None or 0 <= self.group_threshold <= 1,
            "link": self.link in LINKS,
        }
        for name, holds in rules.items():
            if not holds:
                raise ValueError(f"{name}: {getattr(self, name)!r} is out of range")
        return self

    @property
    def quality(self) -> QualitySettings:
        return QualitySettings(minimum_sharpness=self.minimum_sharpness, duplicate_distance=self.duplicate_distance)

    @property
    def grouping(self) -> GroupingSettings:
        """Room for shared photos of two links is kept free unless that would go under the minimum."""
        spare = self.max_per_group - 2 * self.overlap
        most = spare if spare >= max(self.min_per_group, 10) else self.max_per_group
        return GroupingSettings(time_gap=self.time_gap, max_per_group=most, min_per_group=self.min_per_group, threshold=self.group_threshold)

    @property
    def planner(self) -> PlannerSettings:
        return PlannerSettings(overlap=self.overlap)


@dataclass(frozen=True)
class ReconstructionRequest:
    """What a reconstruction is asked for; checked before anything is started."""

    input_folder: str
    model_file: str | None = None
    point_cloud_file: str | None = None

    def validate(self, is_folder=os.path.isdir) -> ReconstructionRequest:
        if not is_folder(self.input_folder):
            raise ValueError(f"not a folder: {self.input_folder}")
        if self.model_file is None and self.point_cloud_file is None:
            raise ValueError("no output: give a model file or a point cloud file")
        for path, ending in ((self.model_file, ".usdz"), (self.point_cloud_file, ".ply")):
            if path is not None and not path.lower().endswith(ending):
                raise ValueError(f"{path}: must end in {ending}")
        return self
