"""Settings that callers pass into the operators; nothing here is global state."""

from __future__ import annotations

from dataclasses import dataclass

# Class lists (list position is the label), channel statistics,
# split ratios in percent, loss weights and stopping limits that must equal the
# ones the data sets were prepared with.
OCT_CLASSES = ("CNV", "DME", "DRUSEN", "NORMAL")
AMD_CLASSES = ("amd", "cataract", "diabetes", "normal")
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
SYMMETRIC_MEAN = (0.5, 0.5, 0.5)
SYMMETRIC_STD = (0.5, 0.5, 0.5)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")


@dataclass(frozen=True)
class SplitSettings:
    seed: int = 42
    test_percent: int = 15
    val_percent: int = 20
    folds: int = 5


@dataclass(frozen=True)
class LossSettings:
    cycle_weight: float = 10.0
    identity_weight: float = 5.0


@dataclass(frozen=True)
class PlateauSettings:
    initial_rate: float = 1e-4
    factor: float = 0.5
    patience: int = 3
    floor: float = 1e-6
    threshold: float = 1e-4


SPLITS = SplitSettings()
LOSSES = LossSettings()
PLATEAU = PlateauSettings()
EARLY_STOP_PATIENCE = 6
EVAL_BATCH_SIZE = 64
