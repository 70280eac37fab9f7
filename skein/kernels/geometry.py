"""Multi-view geometry on arrays: cameras, poses, triangulation, alignment."""

from __future__ import annotations

import numpy as np

from .robust import least_absolute, polynomial_roots, ransac, trials

# Cameras ---------------------------------------------------------------------

#: Camera models by number: name and parameter names (fixed values).
MODELS = {
    0: ("SIMPLE_PINHOLE", "f cx cy"),
    1: ("PINHOLE", "fx fy cx cy"),
    2: ("SIMPLE_RADIAL", "f cx cy k"),
    3: ("RADIAL", "f cx cy k1 k2"),
    4: ("OPENCV", "fx fy cx cy k1 k2 p1 p2"),
    5: ("OPENCV_FISHEYE", "fx fy cx cy k1 k2 k3 k4"),
    6: ("FULL_OPENCV", "fx fy cx cy k1 k2 p1 p2 k3 k4 k5 k6"),
    7: ("FOV", "fx fy cx cy omega"),
    8: ("SIMPLE_RADIAL_FISHEYE", "f cx cy k"),
    9: ("RADIAL_FISHEYE", "f cx cy k1 k2"),
    10: ("THIN_PRISM_FISHEYE", "fx fy cx cy k1 k2 p1 p2 k3 k4 sx1 sy1"),
}


def _named(model: int, params) -> dict[str, float]:
    p = dict(zip(MODELS[model][1].split(), params))
    p.setdefault("fx", p.get("f"))
    p.setdefault("fy", p.get("f"))
    return p


def distort(model: int, params, uv: np.ndarray) -> np.ndarray:
    """Normalised image coordinates after the lens."""
    p, name = _named(model, params), MODELS[model][0]
    u, v = uv[:, 0], uv[:, 1]
    if "FISHEYE" in name:
        r = np.hypot(u, v)
        k = np.where(r > 1e-12, np.arctan(r) / np.maximum(r, 1e-12), 1.0)
        u, v = u * k, v * k
    r2 = u * u + v * v
    if name == "FOV":
        r, w = np.sqrt(r2), p["omega"]
        k = np.ones_like(r) if abs(w) < 1e-8 else np.where(r > 1e-8, np.arctan(2 * r * np.tan(w / 2)) / np.maximum(r * w, 1e-12), 2 * np.tan(w / 2) / w)
        return np.stack([u * k, v * k], axis=1)
    if name in ("SIMPLE_PINHOLE", "PINHOLE"):
        return uv.astype(float)
    k1 = p.get("k1", p.get("k", 0.0))
    radial = 1 + k1 * r2 + p.get("k2", 0) * r2**2
    if name in ("OPENCV_FISHEYE", "THIN_PRISM_FISHEYE"):
        radial = radial + p["k3"] * r2**3 + p["k4"] * r2**4
    if name == "FULL_OPENCV":
        radial = (radial + p["k3"] * r2**3) / (1 + p["k4"] * r2 + p["k5"] * r2**2 + p["k6"] * r2**3)
    p1, p2 = p.get("p1", 0.0), p.get("p2", 0.0)
    du = 2 * p1 * u * v + p2 * (r2 + 2 * u * u) + p.get("sx1", 0.0) * r2
    dv = 2 * p2 * u * v + p1 * (r2 + 2 * v * v) + p.get("sy1", 0.0) * r2
    return np.stack([u * radial + du, v * radial + dv], axis=1)


def undistort(model: int, params, uv: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Inverse of ``distort`` by damped Newton steps with numerical derivatives."""
    x = uv.astype(float).copy()
    if "FISHEYE" in MODELS[model][0]:
        r = np.hypot(x[:, 0], x[:, 1])
        x *= np.where(r > 1e-12, np.tan(np.minimum(r, 1.5)) / np.maximum(r, 1e-12), 1.0)[:, None]
    for _ in range(rounds):
        off = distort(model, params, x) - uv
        if np.abs(off).max(initial=0) < 1e-12:
            break
        h = 1e-7
        a = (distort(model, params, x + [h, 0]) - distort(model, params, x - [h, 0])) / (2 * h)
        b = (distort(model, params, x + [0, h]) - distort(model, params, x - [0, h])) / (2 * h)
        det = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        det = np.where(np.abs(det) < 1e-12, 1e-12, det)
        x -= np.stack([(b[:, 1] * off[:, 0] - b[:, 0] * off[:, 1]) / det, (a[:, 0] * off[:, 1] - a[:, 1] * off[:, 0]) / det], axis=1)
    return x


def to_image(model: int, params, uv: np.ndarray) -> np.ndarray:
    """Normalised coordinates to pixels."""
    p = _named(model, params)
    return distort(model, params, uv) * [p["fx"], p["fy"]] + [p["cx"], p["cy"]]


def to_world(model: int, params, xy: np.ndarray) -> np.ndarray:
    """Pixels to normalised coordinates."""
    p = _named(model, params)
    return undistort(model, params, (xy - [p["cx"], p["cy"]]) / [p["fx"], p["fy"]])


def calibration(model: int, params) -> np.ndarray:
    p = _named(model, params)
    return np.array([[p["fx"], 0, p["cx"]], [0, p["fy"], p["cy"]], [0, 0, 1]])


# Rotations --------------------------------------------------------------------


def skew(v) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0.0]])


def exp_rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    angle = np.linalg.norm(v)
    k = skew(v)
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


def exp_rotations(v: np.ndarray) -> np.ndarray:
    """Rotation matrices (m, 3, 3) of rotation vectors (m, 3)."""
    angle = np.linalg.norm(v, axis=1)
    small = angle < 1e-12
    safe = np.where(small, 1, angle)
    k = np.zeros((len(v), 3, 3))
    for i in range(3):
        a, b = (i + 1) % 3, (i + 2) % 3
        k[:, b, a], k[:, a, b] = v[:, i], -v[:, i]
    one, two = np.where(small, 1, np.sin(safe) / safe), np.where(small, 0, (1 - np.cos(safe)) / safe**2)
    return np.eye(3) + one[:, None, None] * k + two[:, None, None] * (k @ k)


def log_rotation(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation matrix."""
    q = to_quaternion(r)
    s = np.linalg.norm(q[1:])
    return 2 * np.arctan2(s, q[0]) / s * q[1:] if s > 1e-12 else 2 * q[1:]


def log_rotations(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices (m, 3, 3)."""
    # Twice the sine times the axis; near half a turn it vanishes, and the axis is an eigenvector.
    v = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], axis=1)
    s, c = np.linalg.norm(v, axis=1), r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2] - 1
    out = np.where(s <= 1e-12, 0.5, np.arctan2(s, c) / np.where(s <= 1e-12, 1, s))[:, None] * v
    far = c < -1.8
    if far.any():
        out[far] = _far_rotations(r[far])
    return out


def _far_rotations(r: np.ndarray) -> np.ndarray:
    k = np.zeros((len(r), 4, 4))
    k[:, 0, 0] = r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]
    for i in range(3):
        a, b = (i + 1) % 3, (i + 2) % 3
        k[:, i + 1, i + 1] = r[:, i, i] - r[:, a, a] - r[:, b, b]
        k[:, i + 1, 0] = r[:, b, a] - r[:, a, b]
        k[:, max(a, b) + 1, min(a, b) + 1] = r[:, a, b] + r[:, b, a]
    q = np.linalg.eigh(k / 3)[1][:, :, -1]  # reads the lower triangle
    q = np.where(q[:, :1] >= 0, q, -q)
    s = np.linalg.norm(q[:, 1:], axis=1)
    small = s <= 1e-12
    return np.where(small, 2.0, 2 * np.arctan2(s, q[:, 0]) / np.where(small, 1, s))[:, None] * q[:, 1:]


def to_quaternion(r: np.ndarray) -> np.ndarray:
    """Unit quaternion (w >= 0) of a rotation matrix."""
    k = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
        [0, r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
        [0, 0, r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
        [0, 0, 0, r[2, 2] - r[0, 0] - r[1, 1]],
    ])
    q = np.linalg.eigh((k + k.T - np.diag(np.diag(k))) / 3)[1][:, -1]
    return q if q[0] >= 0 else -q


def from_quaternion(q) -> np.ndarray:
    w, x, y, z = np.asarray(q, dtype=float) / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def mean_quaternion(quaternions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean: largest eigenvector of the sum of w q q'."""
    q = np.linalg.eigh((quaternions * weights[:, None]).T @ quaternions)[1][:, -1]
    return q if q[0] >= 0 else -q


def average_rotations(n: int, rows, cols, relative: np.ndarray, *, rounds: int = 100, robust: bool = True, method: str = "L1_IRLS") -> np.ndarray:
    """Global rotations (n, 3, 3) from relative ones R_ij = R_j R_i'.

    ``L1_IRLS`` starts along a breadth-first tree from node 0, then solves for small
    updates, first by least absolute deviations, then by reweighted least squares.
    ``NONLINEAR`` minimises a soft L1 norm of the angles from the same start, ``LAGRANGE_DUAL``
    solves the semidefinite relaxation.
    """
    if method == "LAGRANGE_DUAL":
        return dual_rotations(n, rows, cols, relative)
    rows, cols, relative = np.asarray(rows, dtype=np.int64), np.asarray(cols, dtype=np.int64), np.asarray(relative)
    out = tree_rotations(n, rows, cols, relative)
    # The system has a row an edge, -1 at its first and 1 at its second node, and none for
    # node 0. It is only held as its normal equations, a node by a node.
    plain = np.linalg.pinv(_laplacian(n, rows, cols, np.ones(len(rows))), hermitian=True)
    for k in range(rounds):
        off = disagreement(out, rows, cols, relative)
        if robust and method == "L1_IRLS" and k < 5:
            step = np.stack([least_absolute(lambda x: _across(n, rows, cols, x), off[:, c], solve=lambda b: plain @ _gathered(n, rows, cols, b)) for c in range(3)], axis=1)
        else:
            size = np.linalg.norm(off, axis=1)
            if method == "NONLINEAR":
                w = 1 / np.sqrt(1 + (size / SOFT_ANGLE) ** 2)
            else:
                w = 1 / (size**2 + np.radians(5) ** 2) ** 2 if robust else np.ones(len(rows))
            right = np.stack([_gathered(n, rows, cols, w * off[:, c]) for c in range(3)], axis=1)
            step = np.linalg.pinv(_laplacian(n, rows, cols, w), hermitian=True) @ right
        out[1:] = out[1:] @ exp_rotations(step) if n > 1 else out[1:]
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return out


#: Edges whose matrices are multiplied at a time.
_EDGES = 1 << 14


def disagreement(found: np.ndarray, rows, cols, relative: np.ndarray) -> np.ndarray:
    """Rotation vectors (m, 3) by which edges differ from global rotations."""
    out = np.empty((len(rows), 3))
    for low in range(0, len(rows), _EDGES):
        at = slice(low, low + _EDGES)
        out[at] = log_rotations(np.swapaxes(found[cols[at]], 1, 2) @ relative[at] @ found[rows[at]])
    return out


def tree_rotations(n: int, rows, cols, relative: np.ndarray) -> np.ndarray:
    """Rotations along a breadth-first tree from node 0, level by level."""
    out, known, new = np.tile(np.eye(3), (n, 1, 1)), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    known[0] = new[0] = True
    left = np.arange(len(rows))
    while len(left) and new.any():
        reached = np.zeros(n, dtype=bool)
        for here, there, back in ((rows, cols, False), (cols, rows, True)):
            use = left[new[here[left]] & ~known[there[left]]]
            to, first = np.unique(there[use], return_index=True)
            r = relative[use[first]]
            out[to] = (np.swapaxes(r, 1, 2) if back else r) @ out[here[use[first]]]
            known[to] = reached[to] = True
        new, left = reached, left[~(known[rows[left]] & known[cols[left]])]
    return out


def _laplacian(n: int, rows, cols, w) -> np.ndarray:
    """The weighted graph's matrix without node 0."""
    own = np.bincount(rows * n + cols, w, n * n).reshape(n, n)
    own = own + own.T
    own[np.arange(n), np.arange(n)] = 0
    return (np.diag(own.sum(axis=1)) - own)[1:, 1:]


def _across(n: int, rows, cols, x: np.ndarray) -> np.ndarray:
    """Differences along edges; node 0 is at zero."""
    whole = np.concatenate([[0.0], x])
    return whole[cols] - whole[rows]


def _gathered(n: int, rows, cols, b: np.ndarray) -> np.ndarray:
    """Values of edges summed at their ends, the transpose of ``_across``."""
    return (np.bincount(cols, b, n) - np.bincount(rows, b, n))[1:]


#: Angle from which the soft L1 norm grows linearly.
SOFT_ANGLE = 0.1


#: What the least eigenvalue of the dual's matrix may fall short of zero by, relative to its largest diagonal entry.
_DUAL = 1e-6


def dual_rotations(n: int, rows, cols, relative: np.ndarray, *, rounds: int = 5_000, tolerance: float = 1e-10) -> np.ndarray:
    """Rotations by block coordinate steps on the semidefinite relaxation.

    Maximises <M, X> over X >= 0 with identity blocks on the diagonal, M holding the
    measured rotations and X_ji standing for R_j R_i'. X is held as V V', V with three rows a
    node and few columns: with the others fixed, the best rows of a node are the polar factor
    of its blocks of M times V. What is found is the relaxation's optimum if L - M >= 0,
    where L holds the symmetric blocks of M V V'; if not, V gets a column along which it gains.
    """
    far = np.asarray(rows) != np.asarray(cols)
    rows, cols, relative = np.asarray(rows, dtype=np.int64)[far], np.asarray(cols, dtype=np.int64)[far], np.asarray(relative)[far]
    # A node's blocks of M stand together.
    ends, others = np.concatenate([cols, rows]), np.concatenate([rows, cols])
    order = np.argsort(ends, kind="stable")
    first, near = np.searchsorted(ends[order], np.arange(n + 1)), others[order]
    m = len(rows)
    blocks = np.empty((len(order), 3, 3))  # transposed: a row of a node's blocks by its columns
    for low in range(0, len(order), _EDGES):
        at = order[low : low + _EDGES]
        r = relative[at % max(m, 1)]
        blocks[low : low + _EDGES] = np.where((at < m)[:, None, None], np.swapaxes(r, 1, 2), r)
    pull = lambda v, k: blocks[first[k] : first[k + 1]].reshape(-1, 3).T @ v[near[first[k] : first[k + 1]]].reshape(-1, v.shape[2])
    v, rng = np.zeros((n, 3, 4)), np.random.default_rng(0)
    v[:, :, :3] = tree_rotations(n, rows, cols, relative)
    while True:
        for _ in range(rounds):
            change = 0.0
            for k in range(n):
                u, s, vt = np.linalg.svd(pull(v, k), full_matrices=False)
                if s[2] > 1e-12 * max(1.0, s[0]):
                    new = u @ vt
                    change = max(change, float(np.abs(new - v[k]).max()))
                    v[k] = new
            if change < tolerance:
                break
        way = _ascent(n, v, pull, first, near, blocks) if v.shape[2] < 3 * n else None
        if way is None:
            break
        # A small step along it, and off the symmetric point.
        v = np.concatenate([v, (0.1 * way / np.abs(way).max() + 1e-3 * rng.normal(size=way.shape))[:, :, None]], axis=2)
        u, _, vt = np.linalg.svd(v, full_matrices=False)
        v = u @ vt
    # The factor of rank three, turned to the first node.
    flat = v.reshape(3 * n, -1)
    out = (flat @ np.linalg.eigh(flat.T @ flat)[1][:, -3:]).reshape(n, 3, 3)
    if np.linalg.det(out).sum() < 0:
        out[:, :, 0] *= -1
    u, _, vt = np.linalg.svd(out)
    u[:, :, 2] *= np.linalg.det(u @ vt)[:, None]
    out = u @ vt
    return out @ out[0].T


def _ascent(n: int, v: np.ndarray, pull, first, near, blocks) -> np.ndarray | None:
    """Values (n, 3) along which the relaxation gains; none at its optimum."""
    s, top = np.zeros((3 * n, 3 * n)), 1.0
    for k in range(n):
        own = pull(v, k) @ v[k].T
        own = (own + own.T) / 2
        top = max(top, float(np.abs(own).max()))
        np.subtract.at(s.reshape(n, 3, n, 3), (k, slice(None), near[first[k] : first[k + 1]]), np.swapaxes(blocks[first[k] : first[k + 1]], 1, 2))
        s[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] += own
    s[np.arange(3 * n), np.arange(3 * n)] += _DUAL * top
    try:
        np.linalg.cholesky(s)
        return None
    except np.linalg.LinAlgError:
        return np.linalg.eigh(s)[1][:, 0].reshape(n, 3)


def align_rotations(truth: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``found`` turned as a whole to agree best with ``truth``."""
    u, _, vt = np.linalg.svd(np.einsum("nij,nik->jk", found, truth))
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return found @ r


# Two views -------------------------------------------------------------------------


def normalise_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their mean with mean distance sqrt(2), and the transform."""
    c = x.mean(axis=0)
    d = np.linalg.norm(x - c, axis=1).mean()
    s = np.sqrt(2) / d if d > 0 else 1.0
    return (x - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def _lifted(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def sampson(f: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared first-order epipolar errors."""
    a, b = _lifted(x), _lifted(y)
    l2, l1 = a @ f.T, b @ f
    return (b * l2).sum(axis=1) ** 2 / (l2[:, 0] ** 2 + l2[:, 1] ** 2 + l1[:, 0] ** 2 + l1[:, 1] ** 2)


def meets(f: np.ndarray, x: np.ndarray, y: np.ndarray, most: float) -> bool:
    """Whether all squared epipolar errors are below ``most``; the first that is not ends it."""
    i, n = 0, 512
    while i < len(x):
        if not sampson(f, x[i : i + n], y[i : i + n]).max() < most:
            return False
        i, n = i + n, 1 << 13
    return len(x) > 0


def _null(rows: np.ndarray) -> np.ndarray:
    """The last right singular vector. Only it needs the square factor, and only where
    there are fewer rows than columns: a tall system's left one would be rows x rows."""
    return np.linalg.svd(rows, full_matrices=len(rows) < rows.shape[1])[2][-1]


class Fundamental8:
    """Eight or more matches, rank two enforced."""

    least = 8

    def fit(self, x, y):
        (a, t1), (b, t2) = normalise_points(x), normalise_points(y)
        rows = np.einsum("ni,nj->nij", _lifted(b), _lifted(a)).reshape(len(a), 9)
        f = _null(rows).reshape(3, 3)
        u, s, vt = np.linalg.svd(f)
        return [t2.T @ (u @ np.diag([s[0], s[1], 0]) @ vt) @ t1]

    residuals = staticmethod(sampson)


class Fundamental7(Fundamental8):
    """Seven matches: one or three matrices of rank two."""

    least = 7

    def fit(self, x, y):
        if len(x) != 7:
            return super().fit(x, y)
        rows = np.einsum("ni,nj->nij", _lifted(y), _lifted(x)).reshape(7, 9)
        f1, f2 = np.linalg.svd(rows)[2][-2:].reshape(2, 3, 3)
        at = np.array([0.0, 1.0, -1.0, 2.0])
        cubic = np.linalg.solve(np.vander(at, 4), [np.linalg.det(k * f1 + (1 - k) * f2) for k in at])
        return [k.real * f1 + (1 - k.real) * f2 for k in polynomial_roots(cubic) if abs(k.imag) < 1e-9]


class Essential8(Fundamental8):
    """Matches in normalised coordinates; both singular values equal."""

    def fit(self, x, y):
        u, s, vt = np.linalg.svd(super().fit(x, y)[0])
        k = (s[0] + s[1]) / 2
        return [u @ np.diag([k, k, 0]) @ vt]


#: Monomials in three unknowns up to degree three: those of degree three, then the others.
_CUBIC = [(3, 0, 0), (2, 1, 0), (2, 0, 1), (1, 2, 0), (1, 1, 1), (1, 0, 2), (0, 3, 0), (0, 2, 1), (0, 1, 2), (0, 0, 3)]
_LOWER = [(2, 0, 0), (1, 1, 0), (1, 0, 1), (0, 2, 0), (0, 1, 1), (0, 0, 2), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


#: Some rotation of four vectors that leaves none of them nearly alone.
_MIXED = np.linalg.qr(np.random.default_rng(5).normal(size=(4, 4)))[0]


def _product(p: dict, q: dict) -> dict:
    out: dict = {}
    for a, x in p.items():
        for b, y in q.items():
            k = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
            out[k] = out.get(k, 0.0) + x * y
    return out


def _total(*terms) -> dict:
    out: dict = {}
    for sign, p in terms:
        for k, x in p.items():
            out[k] = out.get(k, 0.0) + sign * x
    return out


class Essential5(Fundamental8):
    """Five matches in normalised coordinates, up to ten models.

    The essential matrix is a combination of four null vectors; its determinant and its
    singular values give ten cubic equations in three unknowns, whose solutions are
    eigenvectors of the matrix by which the first unknown multiplies the lower monomials.
    Eight matches or more are fitted linearly.
    """

    least = 5

    def fit(self, x, y):
        if len(x) >= 8:
            return Essential8().fit(x, y)
        a, b = _lifted(x), _lifted(y)
        basis = np.linalg.svd((b[:, :, None] * a[:, None, :]).reshape(len(x), 9))[2][-4:]
        # Mixed, as the last one's coefficient is set to one and must not vanish.
        basis = (_MIXED @ basis).reshape(4, 3, 3)
        units = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]
        m = [[{u: basis[k, i, j] for k, u in enumerate(units)} for j in range(3)] for i in range(3)]
        square = [[_total(*[(1, _product(m[i][k], m[j][k])) for k in range(3)]) for j in range(3)] for i in range(3)]
        trace = _total(*[(1, square[i][i]) for i in range(3)])
        rows = [_total(*[(2, _product(square[i][k], m[k][j])) for k in range(3)], (-1, _product(trace, m[i][j]))) for i in range(3) for j in range(3)]
        minor = lambda i, j: _total((1, _product(m[1][i], m[2][j])), (-1, _product(m[1][j], m[2][i])))
        rows.append(_total((1, _product(m[0][0], minor(1, 2))), (-1, _product(m[0][1], minor(0, 2))), (1, _product(m[0][2], minor(0, 1)))))
        system = np.array([[r.get(k, 0.0) for k in _CUBIC + _LOWER] for r in rows])
        try:
            reduced = np.linalg.solve(system[:, :10], system[:, 10:])
        except np.linalg.LinAlgError:
            return []
        action = np.zeros((10, 10))
        for i, (p, q, r) in enumerate(_LOWER):
            k = (p + 1, q, r)
            if k in _CUBIC:
                action[i] = -reduced[_CUBIC.index(k)]
            else:
                action[i, _LOWER.index(k)] = 1
        out = []
        for v in np.linalg.eig(action)[1].T:
            if abs(v[9]) < 1e-12 or np.abs((v / v[9]).imag).max() > 1e-6:
                continue
            w = (v / v[9]).real
            e = w[6] * basis[0] + w[7] * basis[1] + w[8] * basis[2] + basis[3]
            out.append(e / np.linalg.norm(e))
        return out


class Homography:
    """Four or more matches of a plane or a turn."""

    least = 4

    def fit(self, x, y):
        (a, t1), (b, t2) = normalise_points(x), normalise_points(y)
        a, rows = _lifted(a), []
        zero = np.zeros_like(a)
        rows = np.concatenate([np.concatenate([a, zero, -a * b[:, :1]], axis=1), np.concatenate([zero, a, -a * b[:, 1:]], axis=1)])
        h = _null(rows).reshape(3, 3)
        return [np.linalg.inv(t2) @ h @ t1]

    @staticmethod
    def residuals(h, x, y):
        p = _lifted(x) @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            off = p[:, :2] / p[:, 2:] - y
        return np.nan_to_num((off**2).sum(axis=1), nan=np.inf)


def epipoles(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, _, vt = np.linalg.svd(f)
    return vt[-1], u[:, -1]


def decompose_essential(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four poses that an essential matrix allows."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1.0]])
    t = u[:, 2]
    return [(r, s * t) for r in (u @ w @ vt, u @ w.T @ vt) for s in (1, -1)]


def decompose_homography(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The motions (R, t, n) of a plane's homography H = R + t n' (normalised
    coordinates, the plane's distance as unit): four, or one if it only turns."""
    h = h / np.linalg.svd(h)[1][1]
    h = h * np.sign(np.linalg.det(h))
    v, (s1, _, s3), _ = np.linalg.svd(h.T @ h)
    if s1 - s3 < 1e-9:
        u, _, vt = np.linalg.svd(h)
        return [(u @ vt, np.zeros(3), np.zeros(3))]
    v = v * np.sign(np.linalg.det(v))
    first, last = np.sqrt(max(0.0, 1 - s3)) * v[:, 0], np.sqrt(max(0.0, s1 - 1)) * v[:, 2]
    out = []
    for u in ((first + last) / np.sqrt(s1 - s3), (first - last) / np.sqrt(s1 - s3)):
        before = np.column_stack([v[:, 1], u, np.cross(v[:, 1], u)])
        after = np.column_stack([h @ v[:, 1], h @ u, np.cross(h @ v[:, 1], h @ u)])
        r, n = after @ before.T, np.cross(v[:, 1], u)
        t = (h - r) @ n
        out += [(r, t, n), (r, -t, -n)]
    return out


def triangulate(p1: np.ndarray, p2: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """World points of matches in normalised coordinates (two 3x4 poses)."""
    return triangulate_views(np.array([p1, p2]), np.stack([x, y], axis=1))


def triangulate_views(poses: np.ndarray, x: np.ndarray) -> np.ndarray:
    """World points (n, 3) seen in all views: x is (n, views, 2)."""
    a = x[..., 0, None] * poses[None, :, 2] - poses[None, :, 0]
    b = x[..., 1, None] * poses[None, :, 2] - poses[None, :, 1]
    v = np.linalg.svd(np.concatenate([a, b], axis=1))[2][:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return v[:, :3] / v[:, 3:]


def recover_pose(e: np.ndarray, x: np.ndarray, y: np.ndarray):
    """(R, t, points) with most points in front of both cameras."""
    first, best, poses = np.eye(3, 4), None, decompose_essential(e)

    def seen(k: int, x, y):
        r, t = poses[k]
        points = triangulate(first, np.column_stack([r, t]), x, y)
        return points, (points[:, 2] > 0) & ((points @ r.T + t)[:, 2] > 0) & np.isfinite(points).all(axis=1)

    order = range(len(poses))
    if len(x) > _SEEN:  # that of the most of some points is tried first: it often has all
        some = np.linspace(0, len(x) - 1, 64).astype(int)
        order = sorted(order, key=lambda k: -int(seen(k, x[some], y[some])[1].sum()))
    for k in order:
        points, front = seen(k, x, y)
        if best is None or (int(front.sum()), -k) > best[:2]:
            best = int(front.sum()), -k, *poses[k], points[front]
        if len(x) > _SEEN and front.all():
            break
    return best[2:]


#: Points from which no pose is tried after one that has all in front.
_SEEN = 1_000


def angles(c1, c2, points) -> np.ndarray:
    """Triangulation angles, the smaller of the two."""
    base, a, b = ((d**2).sum(axis=-1) for d in (np.asarray(c1) - c2, points - c1, points - c2))
    below = 2 * np.sqrt(a * b)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((a + b - base) / below, -1, 1))
    return np.where(below == 0, 0.0, np.minimum(angle, np.pi - angle))


def two_view(x: np.ndarray, y: np.ndarray, *, calibrated: bool, most: float, least: int = 15, seed: int = 0) -> dict:
    """Geometry of a pair: configuration, inliers and, if calibrated, the pose.

    Points are normalised coordinates if ``calibrated``, else pixels; ``most``
    bounds residuals in the same unit. Configurations are numbered as in the store.
    """
    none = {"config": 1, "inliers": np.zeros(len(x), dtype=bool), "R": None, "t": None, "angle": 0.0}
    if len(x) < least:
        return none
    epipolar = ransac(Essential8() if calibrated else Fundamental7(), x, y, most**2, local=3, seed=seed)
    n = int(epipolar[1].sum()) if epipolar else 0
    # A plane counts from 0.8 n inliers: if that many agree, one of so many samples is free of others.
    tried = min(10_000, trials(int(0.8 * n), len(x), 1 - 1e-6, Homography.least)) if n >= least else 10_000
    plane = ransac(Homography(), x, y, most**2, max_trials=tried, local=3, seed=seed)
    n, m = (int(r[1].sum()) if r else 0 for r in (epipolar, plane))
    if max(n, m) < least:
        return none
    out = {"config": 2 if calibrated else 3, "inliers": epipolar[1] if epipolar else plane[1], "R": None, "t": None, "angle": 0.0}
    if m > 0.8 * n:
        out |= {"config": 6, "inliers": plane[1] if m >= n else epipolar[1]}
    if calibrated and epipolar:
        good = out["inliers"]
        r, t, points = recover_pose(epipolar[0], x[good], y[good])
        if len(points):
            out |= {"R": r, "t": t, "angle": float(np.median(angles(np.zeros(3), -r.T @ t, points)))}
            if out["config"] == 6:
                out["config"] = 5 if np.linalg.norm(t) < 1e-9 or out["angle"] < 1e-3 else 4
    return out


def watermark(x: np.ndarray, y: np.ndarray, width: float, height: float, *, border: float = 0.1, share: float = 0.7, most: float = 4.0) -> bool:
    """Whether most matches lie in the border and agree with a pure shift."""
    d = border * np.hypot(width, height)
    edge = lambda p: (p[:, 0] < d) | (p[:, 1] < d) | (p[:, 0] > width - d) | (p[:, 1] > height - d)
    near = edge(x) & edge(y)
    if not len(x) or near.mean() < share:
        return False
    found = ransac(Translation(), x, y, most**2)
    return found is not None and found[1].mean() >= share


# Alignment ---------------------------------------------------------------------------


class Similarity:
    """Scale, rotation and translation between point sets (a 3x4 matrix)."""

    least = 3

    def __init__(self, scale: bool = True) -> None:
        self.scale = scale

    def fit(self, x, y):
        cx, cy = x.mean(axis=0), y.mean(axis=0)
        a, b = x - cx, y - cy
        u, s, vt = np.linalg.svd(b.T @ a / len(x))
        d = np.ones(x.shape[1])
        d[-1] = np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1
        r = u @ np.diag(d) @ vt
        spread = (a**2).sum() / len(x)
        k = (s * d).sum() / spread if self.scale and spread > 0 else 1.0
        return [np.column_stack([k * r, cy - k * r @ cx])]

    @staticmethod
    def residuals(m, x, y):
        return ((x @ m[:, :-1].T + m[:, -1] - y) ** 2).sum(axis=1)


class Affine(Similarity):
    least = 3

    def fit(self, x, y):
        return [np.linalg.lstsq(_lifted(x), y, rcond=None)[0].T]


class Translation(Similarity):
    least = 1

    def fit(self, x, y):
        return [np.column_stack([np.eye(x.shape[1]), (y - x).mean(axis=0)])]


# Absolute pose -------------------------------------------------------------------------


class PnP:
    """Pose from world points and normalised image points (six or more, linear)."""

    least = 6

    def fit(self, x, y):
        c, s = x.mean(axis=0), max(1e-12, np.abs(x - x.mean(axis=0)).max())
        a = np.column_stack([(x - c) / s, np.ones(len(x))])
        zero = np.zeros_like(a)
        rows = np.concatenate([np.concatenate([a, zero, -a * y[:, :1]], axis=1), np.concatenate([zero, a, -a * y[:, 1:]], axis=1)])
        p = np.linalg.svd(rows)[2][-1].reshape(3, 4)
        p = p * np.sign(np.median(a @ p[2]))
        u, k, vt = np.linalg.svd(p[:, :3])
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        t = p[:, 3] * s / k.mean() - r @ c
        return [refine_pose(np.column_stack([r, t]), x, y)]

    @staticmethod
    def residuals(pose, x, y):
        out = np.empty(len(x))
        for i in range(0, len(x), _ROWS):
            p, q = _moved(pose, x[i : i + _ROWS]), y[i : i + _ROWS]
            with np.errstate(divide="ignore", invalid="ignore"):
                off = (p[0] / p[2] - q[:, 0]) ** 2 + (p[1] / p[2] - q[:, 1]) ** 2
            out[i : i + _ROWS] = np.where(p[2] > 0, off, np.inf)
        return out


class P3P(PnP):
    """Three points: distances along the rays from a quartic, then orientation."""

    least = 3

    def fit(self, x, y):
        if len(x) >= 6:
            return super().fit(x, y)
        ray = np.column_stack([y[:3], np.ones(3)])
        ray /= np.linalg.norm(ray, axis=1, keepdims=True)
        a2, b2, c2 = (((x[i] - x[j]) ** 2).sum() for i, j in ((1, 2), (0, 2), (0, 1)))
        if min(a2, b2, c2) < 1e-18:
            return []
        ca, cb, cg = ray[1] @ ray[2], ray[0] @ ray[2], ray[0] @ ray[1]
        p, q, r, s = (a2 - c2) / b2, (a2 + c2) / b2, (b2 - c2) / b2, (b2 - a2) / b2
        quartic = [
            (p - 1) ** 2 - 4 * c2 / b2 * ca**2,
            4 * (p * (1 - p) * cb - (1 - q) * ca * cg + 2 * c2 / b2 * ca**2 * cb),
            2 * (p**2 - 1 + 2 * p**2 * cb**2 + 2 * r * ca**2 - 4 * q * ca * cb * cg + 2 * s * cg**2),
            4 * (-p * (1 + p) * cb + 2 * a2 / b2 * cg**2 * cb - (1 - q) * ca * cg),
            (1 + p) ** 2 - 4 * a2 / b2 * cg**2,
        ]
        out = []
        for root in polynomial_roots(quartic):
            v, below = root.real, 2 * (cg - root.real * ca)
            if abs(root.imag) > 1e-6 or v <= 0 or abs(below) < 1e-12:
                continue
            u = ((p - 1) * v * v - 2 * p * cb * v + 1 + p) / below
            length = 1 + u * u - 2 * u * cg
            if u <= 0 or length <= 0:
                continue
            d = np.sqrt(c2 / length) * np.array([1, u, v])
            out.append(Similarity(scale=False).fit(x[:3], ray * d[:, None])[0])
        return out


#: Points whose projections are worked on at a time: they stay in a core's cache.
_ROWS = 1 << 13


def _moved(pose: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Coordinates of points in a camera, each an array."""
    a, b, c = x[:, 0], x[:, 1], x[:, 2]
    return [r[0] * a + r[1] * b + r[2] * c + r[3] for r in pose]


def _pose_rows(pose: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Derivatives of the reprojection errors by turn and shift, and the errors: (7, 2 n).

    ``held``: an array of at least that size, in which they are returned.
    """
    p, out = _moved(pose, x), held[: 14 * len(x)].reshape(7, 2, len(x))
    z = np.where(np.abs(p[2]) < 1e-12, 1e-12, p[2])
    u, v, a = p[0] / z, p[1] / z, 1 / z
    q, b, c = [p[i] - pose[i, 3] for i in range(3)], -u * a, -v * a
    out[0, 0], out[1, 0], out[2, 0] = b * q[1], a * q[2] - b * q[0], -a * q[1]
    out[0, 1], out[1, 1], out[2, 1] = c * q[1] - a * q[2], -c * q[0], a * q[0]
    out[3, 0] = out[4, 1] = a
    out[3, 1] = out[4, 0] = 0
    out[5, 0], out[5, 1] = b, c
    out[6, 0], out[6, 1] = u - y[:, 0], v - y[:, 1]
    return out.reshape(7, -1)


def refine_pose(pose: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Gauss-Newton on the reprojection error; many points are summed up to normal equations."""
    held = np.empty(14 * min(len(x), _ROWS))
    for _ in range(rounds):
        if len(x) <= _ROWS:
            rows = _pose_rows(pose, x, y, held)
            step = np.linalg.lstsq(rows[:6].T, -rows[6], rcond=None)[0]
        else:
            m = sum((w := _pose_rows(pose, x[i : i + _ROWS], y[i : i + _ROWS], held)) @ w.T for i in range(0, len(x), _ROWS))
            step = np.linalg.lstsq(m[:6, :6], -m[:6, 6], rcond=None)[0]
        pose = np.column_stack([exp_rotation(step[:3]) @ pose[:, :3], pose[:, 3] + step[3:]])
        if np.abs(step).max() < 1e-10:
            break
    return pose


# Bundle adjustment -----------------------------------------------------------------------


#: Pairs of a point's observations that are worked on at a time (about 300 bytes each).
_PAIRS = 1 << 17


def _pairs_of(point: np.ndarray):
    """Places (i, j) of all ordered pairs of observations of the same point, in pieces."""
    order = np.argsort(point, kind="stable")
    held = point[order]
    first, last = np.searchsorted(held, held), np.searchsorted(held, held, side="right")
    total = np.concatenate([[0], np.cumsum(last - first)])
    start = 0
    while start < len(order):
        end = max(start + 1, int(np.searchsorted(total, total[start] + _PAIRS, side="right")) - 1)
        count = (last - first)[start:end]
        i = np.repeat(np.arange(start, end), count)
        j = np.repeat(first[start:end], count) + np.arange(len(i)) - np.repeat(total[start:end] - total[start], count)
        yield order[i], order[j]
        start = end


def bundle_adjust(poses: np.ndarray, points: np.ndarray, view, point, x, *, fixed=(0,), rounds: int = 30, loss: float | None = None):
    """Refine poses (n, 3, 4) and points (m, 3) on normalised observations.

    Levenberg-Marquardt; points are eliminated (Schur complement), so the system
    solved has six unknowns a view. ``fixed`` views keep their pose; ``loss`` is
    the width of a soft-L1 loss. Returns (poses, points, mean squared error).
    """
    poses, points = poses.copy(), points.copy()
    view, point, x = np.asarray(view), np.asarray(point), np.asarray(x, dtype=float)

    def state(poses, points):
        p = np.einsum("nij,nj->ni", poses[view, :, :3], points[point]) + poses[view, :, 3]
        z = np.where(np.abs(p[:, 2]) < 1e-12, 1e-12, p[:, 2])
        return p, z, p[:, :2] / z[:, None] - x

    def cost(off):
        e = (off**2).sum(axis=1)
        return float((e if loss is None else 2 * loss**2 * (np.sqrt(1 + e / loss**2) - 1)).sum())

    n, m, damping = len(poses), len(points), 1e-4
    p, z, off = state(poses, points)
    now = cost(off)
    for _ in range(rounds):
        w = np.ones(len(x)) if loss is None else 1 / np.sqrt(1 + (off**2).sum(axis=1) / loss**2)
        d = np.zeros((len(x), 2, 3))
        d[:, 0, 0] = d[:, 1, 1] = 1 / z
        d[:, :, 2] = -p[:, :2] / z[:, None] ** 2
        turned = p - poses[view, :, 3]
        turn = np.zeros((len(x), 3, 3))
        turn[:, 0, 1], turn[:, 0, 2], turn[:, 1, 0] = turned[:, 2], -turned[:, 1], -turned[:, 2]
        turn[:, 1, 2], turn[:, 2, 0], turn[:, 2, 1] = turned[:, 0], turned[:, 1], -turned[:, 0]
        jc, jp = np.concatenate([d @ turn, d], axis=2), d @ poses[view, :, :3]
        jc[np.isin(view, fixed)] = 0
        wj = jc * w[:, None, None]
        u, v, g, h = np.zeros((n, 6, 6)), np.zeros((m, 3, 3)), np.zeros((n, 6)), np.zeros((m, 3))
        np.add.at(u, view, np.einsum("nki,nkj->nij", wj, jc))
        np.add.at(v, point, np.einsum("nki,nkj->nij", jp * w[:, None, None], jp))
        np.add.at(g, view, -np.einsum("nki,nk->ni", wj, off))
        np.add.at(h, point, -np.einsum("nki,nk->ni", jp * w[:, None, None], off))
        cross = np.einsum("nki,nkj->nij", wj, jp)
        while damping < 1e12:
            vi = np.linalg.inv(v + damping * np.eye(3) * (np.trace(v, axis1=1, axis2=2)[:, None, None] / 3 + 1e-12))
            s, r = np.zeros((n * 6, n * 6)), g.copy()
            for i in range(n):
                s[i * 6 : i * 6 + 6, i * 6 : i * 6 + 6] = u[i] + damping * np.diag(np.diag(u[i]) + 1e-12) + np.eye(6) * (1e-12 if i not in fixed else 1)
            left = cross @ vi[point]
            np.add.at(r, view, -np.einsum("nij,nj->ni", left, h[point]))
            blocks = s.reshape(n, 6, n, 6).swapaxes(1, 2).copy()
            for i, j in _pairs_of(point):
                key = view[i] * n + view[j]
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
                at = key[order[first]]
                blocks[at // n, at % n] -= np.add.reduceat(left[i[order]] @ cross[j[order]].swapaxes(1, 2), first)
            s = blocks.swapaxes(1, 2).reshape(n * 6, n * 6)
            dc = np.linalg.solve(s, r.reshape(-1)).reshape(n, 6)
            back = h.copy()
            np.add.at(back, point, -np.einsum("nij,ni->nj", cross, dc[view]))
            dp = np.einsum("nij,nj->ni", vi, back)
            trial = np.stack([np.column_stack([exp_rotation(c[:3]) @ q[:, :3], q[:, 3] + c[3:]]) for c, q in zip(dc, poses)])
            tp, tz, toff = state(trial, points + dp)
            if (new := cost(toff)) <= now:
                break
            damping *= 10
        else:
            break
        gain, now = now - new, new
        poses, points, p, z, off, damping = trial, points + dp, tp, tz, toff, max(1e-12, damping / 10)
        if gain <= 1e-14 * max(1.0, now):
            break
    return poses, points, now / max(1, len(x))


def xyz_to_ellipsoid(xyz: np.ndarray, a: float = 6378137.0, f: float = 1 / 298.257223563) -> np.ndarray:
    """Earth-centred coordinates to latitude, longitude (degrees) and altitude."""
    e2 = f * (2 - f)
    x, y, z = xyz.T
    r = np.hypot(x, y)
    lat = np.arctan2(z, r * (1 - e2))
    for _ in range(100):
        n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        alt = r / np.cos(lat) - n
        new = np.arctan2(z, r * (1 - e2 * n / (n + alt)))
        if np.abs(new - lat).max(initial=0) < 1e-12:
            lat = new
            break
        lat = new
    return np.stack([np.degrees(lat), np.degrees(np.arctan2(y, x)), alt], axis=1)
