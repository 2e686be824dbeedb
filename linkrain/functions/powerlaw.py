"""Power law between specific attenuation and rain rate: ITU-R coefficients, and rain rates from attenuation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.57721566

#: Fixed values of ITU-R P.838-3: rows (a, b, c) of the Gaussian terms, slope m and offset c.
P838 = {
    "k_H": ([(-5.33980, -0.10008, 1.13098), (-0.35351, 1.26970, 0.45400), (-0.23789, 0.86036, 0.15354), (-0.94158, 0.64552, 0.16817)], -0.18961, 0.71147),
    "k_V": ([(-3.80595, 0.56934, 0.81061), (-3.44965, -0.22911, 0.51059), (-0.39902, 0.73042, 0.11899), (0.50167, 1.07319, 0.27195)], -0.16398, 0.63297),
    "alpha_H": ([(-0.14318, 1.82442, -0.55187), (0.29591, 0.77564, 0.19822), (0.32177, 0.63773, 0.13164), (-5.37610, -0.96230, 1.47828), (16.1721, -3.29980, 3.43990)], 0.67849, -1.95537),
    "alpha_V": ([(-0.07771, 2.33840, -0.76284), (0.56727, 0.95545, 0.54039), (-0.20238, 1.14520, 0.26809), (-48.2991, 0.791669, 0.116226), (48.5833, 0.791459, 0.116479)], -0.053739, 0.83433),
}
#: Fixed values of the 2003 table.
TABLE_2003 = {
    "f": [1, 2, 4, 6, 7, 8, 10, 12, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100],
    "k_H": [3.87e-5, 2e-4, 6e-4, 1.8e-3, 3e-3, 4.5e-3, 0.0101, 0.0188, 0.0367, 0.0751, 0.124, 0.187, 0.263, 0.35, 0.442, 0.536, 0.707, 0.851, 0.975, 1.06, 1.12],
    "k_V": [3.52e-5, 1e-4, 6e-4, 1.6e-3, 2.6e-3, 4e-3, 8.9e-3, 0.0168, 0.0335, 0.0691, 0.113, 0.167, 0.233, 0.31, 0.393, 0.479, 0.642, 0.784, 0.906, 0.999, 1.06],
    "alpha_H": [0.912, 0.963, 1.121, 1.308, 1.332, 1.327, 1.276, 1.217, 1.154, 1.099, 1.061, 1.021, 0.979, 0.939, 0.903, 0.873, 0.826, 0.793, 0.769, 0.753, 0.743],
    "alpha_V": [0.88, 0.923, 1.075, 1.265, 1.312, 1.31, 1.264, 1.2, 1.128, 1.065, 1.03, 1.0, 0.963, 0.929, 0.897, 0.868, 0.824, 0.793, 0.769, 0.754, 0.744],
}
#: Fixed value: the one place where the printed 2005 table is not the rounded formula.
PRINTED = {("alpha_V", 4.0): 1.2476}
_V = ("v", "V", "vertical", "Vertical")
_H = ("h", "H", "horizontal", "Horizontal")


def _published(name: str, f: np.ndarray) -> np.ndarray:
    """The formula's values, rounded as the recommendation's table prints them: four places, one more per leading zero, seven at most."""
    terms, m, c = P838[name]
    x = np.log10(f)
    y = sum(a * np.exp(-(((x - b) / w) ** 2)) for a, b, w in terms) + m * x + c
    if name.startswith("alpha"):
        return np.round(y, 4)
    k = 10**y
    places = np.clip(4 - np.floor(np.log10(k)) - 1, 4, 7).astype(int)
    return np.array([round(float(v), int(p)) for v, p in zip(k, places)])


#: Tables and splines that were made already; plain dicts, so that functions which use them can be sent to workers.
_MADE: dict = {}


def _once(*key, make):
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def table(name: str) -> dict[str, np.ndarray]:
    """Frequencies and coefficients of a table: f, k_H, k_V, alpha_H, alpha_V."""
    return _once(name, make=lambda: _table(name))


def _table(name: str) -> dict[str, np.ndarray]:
    if name == "ITU_2003":
        return {k: np.array(v, float) for k, v in TABLE_2003.items()}
    if name == "ITU_2005":
        f = np.concatenate([np.arange(1, 6, 0.5), np.arange(6, 101, 1.0)])
        out = {"f": f} | {k: _published(k, f) for k in P838}
        for (k, at), value in PRINTED.items():
            out[k][f == at] = value
        return out
    raise ValueError(f"table {name} is not available; ITU_2003 and ITU_2005 are")


def spline(name: str, column: str) -> np.ndarray:
    """Cubic spline without knots at the second and last but one node: rows of (c0, c1, c2, c3) for each interval."""
    return _once(name, column, make=lambda: _spline(name, column))


def _spline(name: str, column: str) -> np.ndarray:
    x, y = table(name)["f"], table(name)[column]
    n, h = len(x), np.diff(x)
    s = np.diff(y) / h
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (s[i] - s[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r)
    return np.column_stack([y[:-1], s - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)])


def polarization(pol: str) -> str:
    if pol in _V:
        return "V"
    if pol in _H:
        return "H"
    raise ValueError(f"polarization {pol} is none of {(*_V, *_H)}")


def a_b_values(f_ghz, pol, approximation: str = "ITU_2005") -> tuple[np.ndarray, np.ndarray]:
    """Coefficients a and b of numbers on the driver or in a worker."""
    f = np.atleast_1d(np.asarray(f_ghz, float))
    pols = np.full(f.shape, pol) if isinstance(pol, str) else np.asarray(pol)
    if f.shape != pols.shape:
        raise ValueError("frequencies and polarizations differ in shape")
    if not ((f >= 1) & (f <= 100)).all():
        raise ValueError("frequencies must be from 1 to 100 GHz")
    x = table(approximation)["f"]
    at = np.clip(np.searchsorted(x, f, "right") - 1, 0, len(x) - 2)
    d = f - x[at]
    side = np.array([polarization(str(p)) for p in pols.ravel()]).reshape(f.shape)
    out = []
    for kind in ("k", "alpha"):
        h, v = (np.polynomial.polynomial.polyval(d, spline(approximation, f"{kind}_{p}")[at].T, tensor=False) for p in "HV")
        out.append(np.where(side == "H", h, v))
    return out[0], out[1]


def a_b(f_ghz: Column, pol: Column, approximation: str = "ITU_2005") -> tuple[Column, Column]:
    """Coefficients as expressions; a frequency or polarization that is not allowed raises, null gives null."""
    nodes = table(approximation)["f"]
    ok = F.when(f_ghz.isNull() | pol.isNull(), F.lit(None).cast("int"))
    ok = ok.when(~f_ghz.between(1, 100), F.raise_error("frequencies must be from 1 to 100 GHz").cast("int"))
    ok = ok.when(~pol.isin(*_V, *_H), F.raise_error("polarization is not known").cast("int"))
    x = F.array(*(F.lit(float(v)) for v in nodes))
    at = ok.otherwise(F.least(F.lit(len(nodes) - 1), F.size(F.filter(x, lambda v: v <= f_ghz))))
    d = f_ghz - F.element_at(x, at)

    def value(column: str) -> Column:
        c = spline(approximation, column)
        c0, c1, c2, c3 = (F.element_at(F.array(*(F.lit(float(v)) for v in c[:, i])), at) for i in range(4))
        return c0 + d * (c1 + d * (c2 + d * c3))

    return tuple(F.when(pol.isin(*_H), value(f"{k}_H")).otherwise(value(f"{k}_V")) for k in ("k", "alpha"))


def _coefficients(f_ghz, pol, a, b, approximation):
    if f_ghz is not None and pol is not None and a is None and b is None:
        return a_b(f_ghz, pol, approximation)
    if f_ghz is None and pol is None and a is not None and b is not None:
        return a, b
    raise ValueError("either f_ghz and pol or a and b are needed, and nothing else")


def rain_rate(att: Column, length_km: Column, f_ghz=None, pol=None, a=None, b=None, approximation: str = "ITU_2005", r_min: float = 0.1) -> Column:
    """(A / (a L)) ** (1 / b); 0 for negative attenuation and below r_min, null for null."""
    a, b = _coefficients(f_ghz, pol, a, b, approximation)
    r = F.when(att < 0, F.lit(0.0)).otherwise(F.pow(att / (a * length_km), F.lit(1.0) / b))
    return F.when(r < r_min, F.lit(0.0)).otherwise(r)


def rain_rate_values(att, length_km: float, f_ghz: float, pol: str, approximation: str = "ITU_2005", r_min: float = 0.1) -> np.ndarray:
    a, b = a_b_values(f_ghz, pol, approximation)
    att = np.atleast_1d(np.asarray(att, float))
    r = np.where(att < 0, 0.0, (np.maximum(att, 0) / (a * length_km)) ** (1 / b))
    return np.where(np.isnan(att), np.nan, np.where(r < r_min, 0.0, r))


def rain_rate_min_max(att_max: Column, length_km: Column, f_ghz=None, pol=None, a=None, b=None, r_min: float = 0.1, k: int = 90) -> Column:
    """Rain rate of attenuations that are the largest of k samples; polarization H if only f_ghz is given."""
    if f_ghz is not None:
        a, b = a_b(f_ghz, F.lit("H") if pol is None else pol)
    a_max = a * F.pow(F.lit(float(np.log(k) + EULER_GAMMA)), b)
    return rain_rate(att_max, length_km, a=a_max, b=b, r_min=r_min)
