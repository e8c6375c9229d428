"""Thresholds and layouts as frozen records; each operator takes one of them, so rules can be changed for a call."""

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Rules:
    """Cut-offs of the hit rule; a nucleus with at least `hits` of the five reasons is abnormal."""

    circularity: float = 0.55
    aspect_ratio: float = 2.2
    roughness: float = 1.35
    solidity: float = 0.55
    least_area: float = 150.0
    most_area: float = 15000.0
    hits: int = 2


JS128 = Rules()
PY128 = Rules(solidity=0.75)


@dataclass(frozen=True)
class Soft:
    """Soft and hard cut-offs and weights of the weighted score."""

    circularity: tuple = (0.75, 0.60, 0.30)
    roughness: tuple = (1.4, 1.8, 0.35)
    aspect_ratio: tuple = (2.0, 2.5, 0.15)
    intensity_std: tuple = (45.0, 60.0, 0.20)
    threshold: float = 0.5


@dataclass(frozen=True)
class Grid:
    tile: int = 512
    overlap: int = 32
    at_least_one: bool = True

    @property
    def step(self) -> int:
        return self.tile - self.overlap


def configured(spark, record, prefix: str):
    """A record with what the session sets under `spark.tessella.<prefix>.<field>` in place of its values, in their types; parts of a tuple are parted by commas."""

    def read(text: str, old):
        if isinstance(old, tuple):
            return tuple(float(part) for part in text.split(","))
        return text.strip().lower() in ("true", "1") if isinstance(old, bool) else type(old)(text)

    given = {f.name: spark.conf.get(f"spark.tessella.{prefix}.{f.name}", None) for f in fields(record)}
    return replace(record, **{name: read(text, getattr(record, name)) for name, text in given.items() if text is not None})


#: File extensions, task states and their labels and colours, labels of reasons and tags.
EXTENSIONS = (".svs", ".tif", ".tiff", ".ndpi", ".mrxs")
STATE_LABELS = {"pending": "等待中", "reading": "读取图像", "super_resolving": "超分重构", "stitching": "图像拼接", "saving": "保存输出", "completed": "已完成", "failed": "失败", "cancelled": "已取消"}
STATE_COLOURS = {"pending": "#909399", "reading": "#409eff", "super_resolving": "#e6a23c", "stitching": "#8e44ad", "saving": "#16a085", "completed": "#67c23a", "failed": "#f56c6c", "cancelled": "#c0c4cc"}
REASON_LABELS = {"low_circularity": "偏离圆形", "high_aspect_ratio": "过度拉长", "high_roughness": "边界毛糙", "low_solidity": "凸性不足", "abnormal_size": "尺寸异常"}
TAG_LABELS = {"polygonal": "多角形", "rough_boundary": "粗糙边界", "spindle": "梭形", "chromatin_aggregation": "染色质聚集", "morphology_suspected": "疑似异型"}
RUNNING = ("reading", "super_resolving", "stitching", "saving")
CANCELABLE = ("pending", *RUNNING)
VIEWABLE = ("completed", "super_resolving", "stitching")
TERMINAL = ("completed", "failed", "cancelled")
