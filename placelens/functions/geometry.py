"""Scalar functions on points, poses, angles and colours, as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cell(x: Column | str, size: float) -> Column:
    """Index of the cell of edge ``size`` that a coordinate lies in."""
    return F.floor(c(x) / F.lit(float(size))).cast("long")


def backproject(u, v, depth, fx: float, fy: float, cx: float, cy: float) -> dict[str, Column]:
    """Camera coordinates of a pixel with depth in millimetres; depth 0 is missing."""
    d = F.when(c(depth) != 0, c(depth) * 0.001)
    return {"x": (c(u) - cx) * d / fx, "y": (c(v) - cy) * d / fy, "z": d}


def project(x, y, z, fx: float, fy: float, cx: float, cy: float) -> dict[str, Column]:
    """Pixel of a point, cut towards zero."""
    return {"u": ((c(x) * fx + c(z) * cx) / c(z)).cast("int"), "v": ((c(y) * fy + c(z) * cy) / c(z)).cast("int")}


def inside_image(u, v, width: int, height: int) -> Column:
    return (c(u) >= 0) & (c(u) < width) & (c(v) >= 0) & (c(v) < height)


def depth_of(z) -> Column:
    """Depth in whole millimetres."""
    return (c(z) * 1000).cast("int")


def apply_pose(m: list[Column | float], x="x", y="y", z="z") -> dict[str, Column]:
    """R p + t; ``m`` is the pose's three rows of four numbers."""
    k = [F.lit(v) if isinstance(v, float) else c(v) for v in m]
    row = lambda i: k[4 * i] * c(x) + k[4 * i + 1] * c(y) + k[4 * i + 2] * c(z) + k[4 * i + 3]
    return {"x": row(0), "y": row(1), "z": row(2)}


def compose(a: Column, b: Column) -> Column:
    """Product of two poses, each an array of 12 numbers."""

    def at(i: int, j: int) -> Column:
        total = sum((a[4 * i + k] * b[4 * k + j] for k in range(3)), F.lit(0.0))
        return total + a[4 * i + 3] if j == 3 else total

    return F.array(*(at(i, j) for i in range(3) for j in range(4)))


def inverse(a: Column) -> Column:
    """Inverse of a rigid pose: the transposed rotation, and minus it times the translation."""
    turned = lambda i: sum((a[4 * k + i] * a[4 * k + 3] for k in range(3)), F.lit(0.0))
    return F.array(*(-turned(i) if j == 3 else a[4 * j + i] for i in range(3) for j in range(4)))


def quat_to_matrix(w, x, y, z) -> list[Column]:
    """Rotation of a quaternion, normalised; the identity for a zero quaternion."""
    n = c(w) * c(w) + c(x) * c(x) + c(y) * c(y) + c(z) * c(z)
    s = F.when(n > 0, F.lit(2.0) / n).otherwise(0.0)
    xx, yy, zz = c(x) * c(x) * s, c(y) * c(y) * s, c(z) * c(z) * s
    xy, xz, yz = c(x) * c(y) * s, c(x) * c(z) * s, c(y) * c(z) * s
    wx, wy, wz = c(w) * c(x) * s, c(w) * c(y) * s, c(w) * c(z) * s
    return [1 - yy - zz, xy - wz, xz + wy, xy + wz, 1 - xx - zz, yz - wx, xz - wy, yz + wx, 1 - xx - yy]


def matrix_to_quat(m: list[Column]) -> dict[str, Column]:
    """Quaternion (w, x, y, z) of a rotation, from the largest of trace and diagonal."""
    a, b, d, e, f, g, h, i, j = m
    trace = a + f + j
    four = [F.sqrt(F.greatest(F.lit(0.0), t)) for t in (1 + trace, 1 + a - f - j, 1 - a + f - j, 1 - a - f + j)]
    parts = (
        (four[0] / 2, (i - g) / (2 * four[0]), (d - h) / (2 * four[0]), (e - b) / (2 * four[0])),
        ((i - g) / (2 * four[1]), four[1] / 2, (b + e) / (2 * four[1]), (d + h) / (2 * four[1])),
        ((d - h) / (2 * four[2]), (b + e) / (2 * four[2]), four[2] / 2, (g + i) / (2 * four[2])),
        ((e - b) / (2 * four[3]), (d + h) / (2 * four[3]), (g + i) / (2 * four[3]), four[3] / 2),
    )
    pick = lambda k: F.when(trace > 0, parts[0][k]).when((a >= f) & (a >= j), parts[1][k]).when(f >= j, parts[2][k]).otherwise(parts[3][k])
    return {n: pick(k) for k, n in enumerate(("w", "x", "y", "z"))}


def spherical_bin(x, y, z, bins: int) -> dict[str, Column]:
    """Range and the bins of polar angle and azimuth, both shifted by pi; null at the origin."""
    r = F.sqrt(c(x) * c(x) + c(y) * c(y) + c(z) * c(z))
    theta = F.lit(pi) + F.acos(c(z) / r)
    phi = F.lit(pi) + F.atan2(c(y), c(x))
    turn = lambda a: F.when(r > 0, F.least(F.lit(bins - 1), F.floor(a / (2 * pi) * bins).cast("int")))
    return {"range": r, "tbin": turn(theta), "pbin": turn(phi)}


def rgb_to_hs(r, g, b) -> dict[str, Column]:
    """Hue in degrees and saturation; hue 0 for greys."""
    hi, lo = F.greatest(c(r), c(g), c(b)), F.least(c(r), c(g), c(b))
    d = (hi - lo).cast("double")
    sector = F.when(hi == c(r), (c(g) - c(b)) / d).when(hi == c(g), (c(b) - c(r)) / d + 2).otherwise((c(r) - c(g)) / d + 4)
    hue = F.when(d == 0, 0.0).otherwise(sector * 60)
    return {"hue": F.when(hue < 0, hue + 360).otherwise(hue), "sat": F.when(hi == 0, 0.0).otherwise(d / hi)}


def robust_weight(residual, kind: str, p: float) -> Column:
    """Weight of a residual under one of six loss shapes with parameter p."""
    a = F.abs(c(residual))
    if kind == "threshold":
        return F.when(a < p, 1.0).otherwise(0.0)
    if kind == "pnorm":
        return F.lit(p) / (F.pow(a, F.lit(2.0 - p)) + 1e-8)
    if kind == "tukey":
        return F.when(a < p, F.pow(1 - F.pow(a / p, 2.0), 2.0)).otherwise(0.0)
    if kind == "fair":
        return 1 / (1 + a / p)
    if kind == "logistic":
        return F.when(a == 0, 1.0).otherwise(F.lit(p) / a * F.tanh(a / p))
    if kind == "none":
        return F.lit(1.0)
    raise ValueError(f"unknown weight {kind}")


def steps(start: int, step: int, end: int) -> int:
    return (end - start) // step + 1


def position_count(pan: tuple[int, int, int], tilt: tuple[int, int, int]) -> int:
    """Positions of a sweep; pan and tilt as (start, step, end)."""
    return steps(*pan) * steps(*tilt)


def angles_of_position(position, pan: tuple[int, int, int], tilt: tuple[int, int, int]) -> dict[str, Column]:
    """Pan and tilt of a position; each second level runs backwards. Null outside the sweep."""
    n = steps(*pan)
    level, k = F.floor(c(position) / n).cast("int"), (c(position) % n).cast("int")
    forth = F.when(level % 2 == 0, k).otherwise(n - 1 - k)
    valid = (c(position) >= 0) & (c(position) < position_count(pan, tilt))
    return {"pan": F.when(valid, pan[0] + forth * pan[1]), "tilt": F.when(valid, tilt[0] + level * tilt[1])}


def position_of_angles(p, t, pan: tuple[int, int, int], tilt: tuple[int, int, int]) -> Column:
    """Position of a pan and tilt; -1 where the pattern does not have it."""
    n = steps(*pan)
    k, level = ((c(p) - pan[0]) / pan[1]).cast("int"), ((c(t) - tilt[0]) / tilt[1]).cast("int")
    fits = (c(p) >= pan[0]) & (c(p) <= pan[2]) & ((c(p) - pan[0]) % pan[1] == 0) & (c(t) >= tilt[0]) & (c(t) <= tilt[2]) & ((c(t) - tilt[0]) % tilt[1] == 0)
    return F.when(fits, level * n + F.when(level % 2 == 0, k).otherwise(n - 1 - k)).otherwise(-1)


def best_class(confidences: Column) -> dict[str, Column]:
    """Class of largest confidence (ties: the last name); unknown with 1.0 for an empty or null map."""
    top = F.array_max(F.transform(F.map_entries(confidences), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return {"class": F.coalesce(top["k"], F.lit("unknown")), "confidence": F.coalesce(top["v"], F.lit(1.0))}


# Fixed value: the digits of keys, in their order.
DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890"


def key_from_number(n) -> Column:
    """A whole number from 0 in base 62, most significant digit first; 0 is empty."""
    powers = [62**k for k in range(10, -1, -1)]
    digit = [F.substring(F.lit(DIGITS), (F.call_function("div", c(n).cast("long"), F.lit(p).cast("long")) % 62).cast("int") + 1, F.lit(1)) for p in powers]
    return F.regexp_replace(F.concat(*digit), f"^{DIGITS[0]}+", "")


def view_heading(x, y, tx, ty) -> dict[str, Column]:
    """Yaw towards a target and its quaternion."""
    yaw = F.atan2(c(ty) - c(y), c(tx) - c(x))
    return {"yaw": yaw, "qz": F.sin(yaw / 2), "qw": F.cos(yaw / 2)}


def rgb_bin(r, g, b, res: int) -> Column:
    """Bin of a colour in a cube of res bins an axis."""
    one = lambda x: F.floor(c(x) * res / 256).cast("int")
    return res * res * one(r) + res * one(g) + one(b)


def path_parts(path) -> dict[str, Column]:
    """Date, patrol and room numbers of a catalog path; null where it has none."""
    part = lambda p: F.nullif(F.regexp_extract(c(path), p, 1), F.lit(""))
    return {"date": part(r"/(\d{8})/"), "patrol": part(r"/patrol_run_(\d+)/").cast("int"), "room": part(r"/room_(\d+)/").cast("int")}


def relative_path(path, root) -> Column:
    """A path below a root without it; other paths stay."""
    base = F.concat(F.rtrim(c(root), F.lit("/")), F.lit("/"))
    return F.when(c(path).startswith(base), F.substring(c(path), F.length(base) + 1, F.length(c(path)))).otherwise(c(path))
