"""Column arithmetic over boxes. A box is four DOUBLE columns x0, y0, x1, y1 with a prefix."""

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    def __init__(self, prefix: str = "", x0: Column | None = None, y0: Column | None = None, x1: Column | None = None, y1: Column | None = None):
        self.x0, self.y0, self.x1, self.y1 = (v if v is not None else F.col(prefix + n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    @property
    def direction(self) -> Column:
        return F.when(self.width >= self.height, "h").otherwise("v")

    def overlap(self, other: "Box", axis: str) -> Column:
        """Length in common on an axis."""
        a, b = (self.x0, self.x1) if axis == "x" else (self.y0, self.y1)
        c, d = (other.x0, other.x1) if axis == "x" else (other.y0, other.y1)
        return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))

    def projected_iou(self, other: "Box", axis: str) -> Column:
        common = self.overlap(other, axis)
        whole = (self.width + other.width if axis == "x" else self.height + other.height) - common
        return F.when(whole > 0, common / whole).otherwise(0.0)

    def common_area(self, other: "Box") -> Column:
        return self.overlap(other, "x") * self.overlap(other, "y")

    def inside(self, other: "Box") -> Column:
        """Share of this box's area that lies in the other; 0 without area."""
        return F.when(self.area > 0, self.common_area(other) / self.area).otherwise(0.0)

    def iou(self, other: "Box") -> Column:
        union = self.area + other.area - self.common_area(other)
        return F.when(union > 0, self.common_area(other) / union).otherwise(0.0)

    def holds(self, x: Column, y: Column) -> Column:
        """Whether a point lies in the box, edges included."""
        return (x >= self.x0) & (x <= self.x1) & (y >= self.y0) & (y <= self.y1)

    def clamped(self, width: Column, height: Column, pad: float = 0.0) -> list[Column]:
        """Corners put in order, padded, rounded outwards and held on the page."""
        lo = lambda a, b: F.greatest(F.lit(0), F.floor(F.least(a, b) - pad))
        hi = lambda a, b, most: F.least(most, F.ceil(F.greatest(a, b) + pad))
        return [lo(self.x0, self.x1), lo(self.y0, self.y1), hi(self.x0, self.x1, width), hi(self.y0, self.y1, height)]

    def written(self) -> Column:
        return F.format_string("%.1f,%.1f,%.1f,%.1f", self.x0, self.y0, self.x1, self.y1)

    def scaled(self, width: Column, height: Column, grid: float = 999.0) -> list[Column]:
        """From a square grid to pixels, one decimal."""
        return [F.round(v / grid * s, 1) for v, s in ((self.x0, width), (self.y0, height), (self.x1, width), (self.y1, height))]


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates: the bounding box of a group."""
    return [F.min(prefix + "x0").alias("x0"), F.min(prefix + "y0").alias("y0"), F.max(prefix + "x1").alias("x1"), F.max(prefix + "y1").alias("y1")]


def polygon_box(points: Column) -> list[Column]:
    """Bounding box of an array of (x, y) pairs."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return [F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)]
