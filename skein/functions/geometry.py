"""Geometry as Column expressions, evaluated in the JVM.

Vectors are tuples of three Columns, quaternions tuples (w, x, y, z); a pose maps
world to camera: ``x_cam = rotate(q, x) + t``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def vector(*names) -> tuple[Column, ...]:
    """Columns (or numbers) as a vector or quaternion."""
    return tuple(_col(n) for n in names)


def dot(a, b) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def add(a, b):
    return tuple(x + y for x, y in zip(a, b))


def subtract(a, b):
    return tuple(x - y for x, y in zip(a, b))


def scale(a, k):
    return tuple(x * k for x in a)


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cross_matrix(a: Vector) -> list[list[Column]]:
    """The matrix M with M b = a x b."""
    zero = F.lit(0.0)
    return [[zero, -a[2], a[1]], [a[2], zero, -a[0]], [-a[1], a[0], zero]]


# Quaternions ----------------------------------------------------------------


def normalized(q: Quaternion) -> Quaternion:
    """Unit length; a zero quaternion becomes (1, x, y, z)."""
    n = norm(q)
    zero = n == 0
    return (F.when(zero, F.lit(1.0)).otherwise(q[0] / F.nullif(n, F.lit(0.0))), *[F.when(zero, c).otherwise(c / F.nullif(n, F.lit(0.0))) for c in q[1:]])


def inverse(q: Quaternion) -> Quaternion:
    """The inverse rotation of a unit quaternion."""
    return (q[0], -q[1], -q[2], -q[3])


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    """Rotation ``a`` after ``b``."""
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def rotate(q: Quaternion, v: Vector) -> Vector:
    """``v`` rotated by a unit quaternion."""
    u = q[1:]
    t = scale(cross(u, v), 2)
    return add(add(v, scale(t, q[0])), cross(u, t))


def to_matrix(q: Quaternion) -> list[list[Column]]:
    """Rotation matrix, by rows."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def from_euler(rx: Column, ry: Column, rz: Column) -> Quaternion:
    """Rotation about x, then y, then z (radians)."""
    about = lambda a, k: tuple(F.cos(a / 2) if i == 0 else F.sin(a / 2) if i == k else F.lit(0.0) for i in range(4))
    return multiply(about(rz, 3), multiply(about(ry, 2), about(rx, 1)))


def to_euler(q: Quaternion) -> Vector:
    """The angles of ``from_euler``."""
    m = to_matrix(q)
    return F.atan2(m[2][1], m[2][2]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0]))), F.atan2(m[1][0], m[0][0])


def between(a: Vector, b: Vector) -> Quaternion:
    """The rotation that turns unit vector ``a`` into ``b``."""
    return normalized((1 + dot(a, b), *cross(a, b)))


def from_angle_axis(v: Vector) -> Quaternion:
    """A rotation vector (axis times angle) as a quaternion."""
    angle = norm(v)
    k = F.when(angle == 0, F.lit(0.5)).otherwise(F.sin(angle / 2) / F.nullif(angle, F.lit(0.0)))
    return (F.cos(angle / 2), v[0] * k, v[1] * k, v[2] * k)


def to_angle_axis(q: Quaternion) -> Vector:
    """A quaternion as a rotation vector of at most half a turn."""
    s = norm(q[1:])
    w = F.when(q[0] < 0, -q[0]).otherwise(q[0])
    sign = F.when(q[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    k = sign * F.when(s == 0, F.lit(2.0)).otherwise(2 * F.atan2(s, w) / F.nullif(s, F.lit(0.0)))
    return scale(q[1:], k)


def multiply_angle_axis(a: Vector, b: Vector) -> Vector:
    """Rotation ``a`` after ``b``, all as rotation vectors."""
    return to_angle_axis(multiply(from_angle_axis(a), from_angle_axis(b)))


def relative_angle_axis(a: Vector, b: Vector) -> Vector:
    """The rotation from frame ``a`` to frame ``b``."""
    return to_angle_axis(multiply(from_angle_axis(b), inverse(from_angle_axis(a))))


# Poses ----------------------------------------------------------------------


def invert_pose(q: Quaternion, t: Vector) -> tuple[Quaternion, Vector]:
    p = inverse(q)
    return p, scale(rotate(p, t), -1)


def concatenate_poses(q1, t1, q2, t2):
    """Pose 1, then pose 2."""
    return multiply(q2, q1), add(t2, rotate(q2, t1))


def relative_pose(q1, t1, q2, t2):
    """The pose that leads from camera 1 to camera 2."""
    q, t = invert_pose(q1, t1)
    return concatenate_poses(q, t, q2, t2)


def centre(q, t) -> Vector:
    """The camera's position in the world."""
    return scale(rotate(inverse(q), t), -1)


def baseline(q1, t1, q2, t2) -> Vector:
    """From the first camera's position to the second's."""
    return subtract(centre(q2, t2), centre(q1, t1))


def interpolate_pose(q1, t1, q2, t2, k: Column):
    """Pose at ``k`` in [0, 1]: spherical for the rotation, linear for ``t``."""
    c = dot(q1, q2)
    sign, c = F.when(c < 0, F.lit(-1.0)).otherwise(F.lit(1.0)), F.least(F.lit(1.0), F.abs(c))
    angle = F.acos(c)
    small = F.sin(angle) < 1e-12
    a = F.when(small, 1 - k).otherwise(F.sin((1 - k) * angle) / F.nullif(F.sin(angle), F.lit(0.0)))
    b = sign * F.when(small, k).otherwise(F.sin(k * angle) / F.nullif(F.sin(angle), F.lit(0.0)))
    return normalized(add(scale(q1, a), scale(q2, b))), add(scale(t1, 1 - k), scale(t2, k))


def transform(s: Column, q: Quaternion, t: Vector, v: Vector) -> Vector:
    """A similarity (scale, rotation, translation) applied to a point."""
    return add(scale(rotate(q, v), s), t)


def invert_similarity(s, q, t):
    p = inverse(q)
    return 1 / s, p, scale(rotate(p, t), -1 / s)


# Projection -----------------------------------------------------------------


def to_camera(q, t, v) -> Vector:
    return add(rotate(q, v), t)


def depth(q, t, v) -> Column:
    """Depth of a world point; positive in front of the camera."""
    return to_camera(q, t, v)[2]


def project(model: Column, f: Column, cx: Column, cy: Column, k1: Column, v: Vector) -> tuple[Column, Column]:
    """Pixel of a camera point: model 0 and 1 pinhole, others one radial term."""
    z = F.when(v[2] > 0, v[2])
    u, w = v[0] / z, v[1] / z
    bend = F.when(model >= 2, 1 + k1 * (u * u + w * w)).otherwise(F.lit(1.0))
    return f * bend * u + cx, f * bend * w + cy


#: A point behind the camera counts as infinitely wrong.
BEHIND = 1.7976931348623157e308


def squared_reprojection_error(pixel, x: Column, y: Column) -> Column:
    """Squared distance of a projected pixel from the observed one."""
    error = (pixel[0] - x) * (pixel[0] - x) + (pixel[1] - y) * (pixel[1] - y)
    return F.coalesce(error, F.lit(BEHIND))


def angular_error(q, t, v, ray: Vector) -> Column:
    """Angle between an observed unit ray and the point's direction."""
    p = to_camera(q, t, v)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(ray, p) / norm(p))))


def triangulation_angle(c1: Vector, c2: Vector, v: Vector) -> Column:
    """Smaller angle between the rays to a point (law of cosines); 0 if degenerate."""
    base, ray1, ray2 = (dot(d, d) for d in (subtract(c1, c2), subtract(v, c1), subtract(v, c2)))
    below = 2 * F.sqrt(ray1 * ray2)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ray1 + ray2 - base) / F.nullif(below, F.lit(0.0))))
    angle = F.acos(cosine)
    return F.coalesce(F.least(angle, math.pi - angle), F.lit(0.0))


def sampson_error(f: list[list[Column]], x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared first-order epipolar error of a match under matrix ``f``."""
    l2 = [f[i][0] * x1 + f[i][1] * y1 + f[i][2] for i in range(3)]
    l1 = [f[0][i] * x2 + f[1][i] * y2 + f[2][i] for i in range(3)]
    e = x2 * l2[0] + y2 * l2[1] + l2[2]
    return e * e / (l2[0] * l2[0] + l2[1] * l2[1] + l1[0] * l1[0] + l1[1] * l1[1])


def homography_error(h: list[list[Column]], x1, y1, x2, y2) -> Column:
    """Squared transfer error of a match under homography ``h``."""
    p = [h[i][0] * x1 + h[i][1] * y1 + h[i][2] for i in range(3)]
    u, v = p[0] / p[2] - x2, p[1] / p[2] - y2
    return u * u + v * v


# Geodesy --------------------------------------------------------------------

#: Semi-major axis and flattening of the ellipsoids (fixed values).
ELLIPSOIDS = {"GRS80": (6378137.0, 1 / 298.257222100882711243), "WGS84": (6378137.0, 1 / 298.257223563)}


def ellipsoid_to_xyz(lat: Column, lon: Column, alt: Column, ellipsoid: str = "WGS84") -> Vector:
    """Geodetic degrees and metres to Earth-centred coordinates."""
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2 - f)
    lat, lon = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + alt) * F.sin(lat)
