"""Shape descriptors, hit rules, soft scores and tags as columns."""

import math

from pyspark.sql import functions as F

from ..config import JS128, Rules, Soft


def circularity(area, perimeter):
    return F.lit(4 * math.pi) * area / (perimeter * perimeter)


def aspect_ratio(major, minor):
    return F.when(minor > 0, major / minor).otherwise(1.0)


def ellipse_perimeter(major, minor):
    """The usual short formula, on full axes."""
    return F.lit(math.pi) * (1.5 * (major + minor) - F.sqrt(major * minor))


def roughness(perimeter, major, minor):
    return perimeter / F.greatest(ellipse_perimeter(major, minor), F.lit(4.0))


def equivalent_diameter(area):
    return 2 * F.sqrt(area / math.pi)


def rectangularity(area, width, height):
    return F.least(F.lit(1.0), area / F.greatest(width * height, F.lit(1.0)))


def smoothness(circ, rough):
    return circ * (1 - F.least(rough, F.lit(3.0)) / 3)


def reasons(circ, aspect, rough, solid, area, rules: Rules = JS128):
    """The names of the rules that are hit, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(circ < rules.circularity, "low_circularity"),
            F.when(aspect > rules.aspect_ratio, "high_aspect_ratio"),
            F.when(rough > rules.roughness, "high_roughness"),
            F.when(solid < rules.solidity, "low_solidity"),
            F.when((area < rules.least_area) | (area > rules.most_area), "abnormal_size"),
        )
    )


def _ramp(value, soft: float, hard: float):
    """0 at the soft cut-off, 1 at the hard one, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - soft) / (hard - soft)))


def sub_scores(circ, rough, aspect, std, soft: Soft = Soft()) -> dict:
    return {"circularity": _ramp(circ, *soft.circularity[:2]), "boundary_roughness": _ramp(rough, *soft.roughness[:2]), "aspect_ratio": _ramp(aspect, *soft.aspect_ratio[:2]), "intensity_std": _ramp(std, *soft.intensity_std[:2])}


def soft_score(circ, rough, aspect, std, soft: Soft = Soft()):
    parts = sub_scores(circ, rough, aspect, std, soft)
    weights = (soft.circularity[2], soft.roughness[2], soft.aspect_ratio[2], soft.intensity_std[2])
    return F.least(F.lit(1.0), sum((w * p for w, p in zip(weights, parts.values())), F.lit(0.0)))


def tags(circ, rough, aspect, std, soft: Soft = Soft()):
    return F.array_compact(
        F.array(
            F.when((circ < soft.circularity[0]) | (rough > soft.roughness[0]), "polygonal"),
            F.when(rough > soft.roughness[0], "rough_boundary"),
            F.when(aspect > soft.aspect_ratio[0], "spindle"),
            F.when(std > soft.intensity_std[0], "chromatin_aggregation"),
        )
    )


def severity_radius(circ, rough, aspect):
    return 15 + F.least(F.lit(30.0), 25 * ((1 - circ) + 0.5 * (rough - 1) + 0.3 * F.greatest(F.lit(0.0), aspect - 1.5)))


def colour(circ, rough, aspect, why):
    red = F.array_contains(why, "low_circularity") | (circ < 0.5)
    return F.when(red, "#ff4444").when(aspect > 2, "#ff9900").when(rough > 1.3, "#ffcc00").otherwise("#409eff")


def score_band(score):
    return F.when(score >= 0.8, "danger").when(score >= 0.6, "warning").otherwise("primary")
