"""Parameters of the acquisition pipelines, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from rasterweave.sources.files import parse_day

# Defaults of the commands.
TRAIN_BUFFER_M, PREDICT_BUFFER_M, MAX_CLOUD, STEP_CLOUD, PREDICT_DAYS, FORDEAD_DAYS, FORDEAD_BLACK, PREDICT_BLACK = 50_000, 2_560, 20, 1, 5, 730, 0.4, 0.8


@dataclass(frozen=True)
class Request:
    """What all requests have: the areas' file and the buffer in metres."""

    source: str
    buffer_m: int = PREDICT_BUFFER_M

    def __post_init__(self):
        if "://" not in self.source and not Path(self.source).exists():
            raise FileNotFoundError(self.source)
        object.__setattr__(self, "buffer_m", abs(int(self.buffer_m)))


@dataclass(frozen=True)
class TrainingRequest(Request):
    """Images of a time span, by the ladder of cloud cover."""

    start: str = ""
    end: str = ""
    max_cloud: int = MAX_CLOUD
    step_cloud: int = STEP_CLOUD
    aoi_indices: tuple[int, ...] = field(default=())
    where: str = "local"

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "start", parse_day(self.start))
        object.__setattr__(self, "end", parse_day(self.end))
        for name in ("max_cloud", "step_cloud"):
            object.__setattr__(self, name, abs(int(getattr(self, name))))
        if self.start > self.end:
            raise ValueError("start is after end")
        if self.step_cloud == 0:
            raise ValueError("step_cloud must not be 0")
        if self.where not in ("local", "gcs"):
            raise ValueError("where must be 'local' or 'gcs'")


@dataclass(frozen=True)
class PredictionRequest(Request):
    """The latest images up to a day."""

    before: str = ""
    days: int = PREDICT_DAYS
    filter_black: bool = False

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "before", parse_day(self.before))
        object.__setattr__(self, "days", abs(int(self.days)))


@dataclass(frozen=True)
class FordeadRequest(Request):
    """All images of [start, start + days)."""

    start: str = ""
    days: int = FORDEAD_DAYS
    filter_black: bool = False
    threshold: float = FORDEAD_BLACK

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "start", parse_day(self.start))
        object.__setattr__(self, "days", abs(int(self.days)))
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be a share")
