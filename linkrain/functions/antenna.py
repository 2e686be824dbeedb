"""Wet antenna attenuation (WAA) as functions of rain rate or of observed attenuation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkrain.functions.powerlaw import rain_rate_values

LIGHT = 299792458
#: Points of the table that inverts observed attenuation, and the exponents of ten it spans.
POINTS, SPAN = 100, (-10, 3)


def _debye(t_kelvin: float) -> tuple[float, float, float, float, float]:
    """Permittivities e0, e1, e2 and relaxation frequencies f1, f2 (GHz) of liquid water after Liebe et al. 1991."""
    t = 1 - 300.0 / t_kelvin
    e0 = 77.66 - 103.3 * t
    f1 = 20.2 + t * (146.4 + 316 * t)
    return e0, 0.0671 * e0, 3.52 + 7.52 * t, f1, 39.8 * f1


def permittivity_values(f_hz, t_kelvin: float):
    e0, e1, e2, f1, f2 = _debye(t_kelvin)
    f = np.asarray(f_hz, float) * 1e-9
    return e2 + (e1 - e2) / (1 - 1j * f / f2) + (e0 - e1) / (1 - 1j * f / f1)


def permittivity(f_hz: Column, t_kelvin: float = 293.0) -> tuple[Column, Column]:
    """Real and imaginary part of the permittivity of water."""
    e0, e1, e2, f1, f2 = _debye(t_kelvin)
    re, im = F.lit(e2), F.lit(0.0)
    for step, relax in ((e1 - e2, f2), (e0 - e1, f1)):
        x = f_hz * 1e-9 / relax
        re, im = re + step / (1 + x * x), im + step * x / (1 + x * x)
    return re, im


def leijnse_values(rain, f_hz, t_kelvin: float = 293.0, gamma: float = 2.06e-5, delta: float = 0.24, n_antenna: complex = 1.73 + 0.014j, l_antenna: float = 0.001) -> np.ndarray:
    """WAA of a water film on an antenna cover; waves run through film (s) and cover (t) in both directions."""
    rain = np.asarray(rain, float)
    film = gamma * rain**delta
    water = np.sqrt(permittivity_values(f_hz, t_kelvin))
    wave = 2j * np.pi * np.asarray(f_hz, float) / LIGHT
    wet, dry = 0, 0
    for t in (1, -1):
        for s in (1, -1):
            wet = wet + (1 + s * water) * (water + s * t * n_antenna) * (n_antenna + t) * np.exp(-t * wave * (n_antenna * l_antenna + s * t * water * film))
        dry = dry + t * (1 + t * n_antenna) ** 2 * np.exp(-t * wave * n_antenna * l_antenna)
    return np.where(rain == 0, 0.0, 20 * np.log10(np.abs(wet / (2 * water * dry))))


@dataclass
class Complex:
    """A complex number of two columns."""

    re: Column
    im: Column

    @staticmethod
    def of(x) -> Complex:
        return x if isinstance(x, Complex) else Complex(F.lit(complex(x).real), F.lit(complex(x).imag))

    def __add__(self, other) -> Complex:
        other = Complex.of(other)
        return Complex(self.re + other.re, self.im + other.im)

    def __mul__(self, other) -> Complex:
        if isinstance(other, (int, float)):
            return Complex(self.re * float(other), self.im * float(other))
        other = Complex.of(other)
        return Complex(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)

    def times(self, x: Column) -> Complex:
        return Complex(self.re * x, self.im * x)

    def square(self) -> Column:
        return self.re * self.re + self.im * self.im

    def exp(self) -> Complex:
        return Complex(F.exp(self.re) * F.cos(self.im), F.exp(self.re) * F.sin(self.im))

    def sqrt(self) -> Complex:
        """The root with positive real part, for a number with an imaginary part that is not negative."""
        size = F.sqrt(self.square())
        return Complex(F.sqrt((size + self.re) / 2), F.sqrt((size - self.re) / 2))


def leijnse(rain: Column, f_hz: Column, t_kelvin: float = 293.0, gamma: float = 2.06e-5, delta: float = 0.24, n_antenna: complex = 1.73 + 0.014j, l_antenna: float = 0.001) -> Column:
    """leijnse_values as an expression; null gives null."""
    film = gamma * F.pow(rain, F.lit(delta))
    water = Complex(*permittivity(f_hz, t_kelvin)).sqrt()
    wave = Complex(F.lit(0.0), f_hz * (2 * math.pi / LIGHT))
    zero = Complex(F.lit(0.0), F.lit(0.0))
    wet, dry = zero, zero
    cover = wave * (n_antenna * l_antenna)
    for t in (1, -1):
        for s in (1, -1):
            way = cover + (wave * water).times(film) * (s * t)
            wet = wet + (water * s + 1) * (water + s * t * n_antenna) * (n_antenna + t) * (way * -t).exp()
        dry = dry + (cover * -t).exp() * (t * (1 + t * n_antenna) ** 2)
    return F.when(rain == 0, F.lit(0.0)).otherwise(10 * F.log10(wet.square() / (4 * water.square() * dry.square())))


def pastorek_values(rain, a_max: float = 14, zeta: float = 0.55, d: float = 0.1) -> np.ndarray:
    rain = np.asarray(rain, float)
    return np.where(rain == 0, 0.0, a_max * (1 - np.exp(-d * rain**zeta)))


def pastorek(rain: Column, a_max: float = 14, zeta: float = 0.55, d: float = 0.1) -> Column:
    return F.when(rain == 0, F.lit(0.0)).otherwise(a_max * (1 - F.exp(-d * F.pow(rain, F.lit(zeta)))))


def _inverse(a_obs: np.ndarray, f_hz: float, pol: str, length_km: float, waa_of) -> np.ndarray:
    """WAA of observed attenuations, by a table of rain attenuation plus the WAA of its rain rate."""
    known = a_obs[~np.isnan(a_obs)]
    if (known < 0).any():
        raise ValueError("negative attenuation is not allowed")
    rain_att = np.logspace(*SPAN, POINTS)
    rain_att[0] = 0
    waa = waa_of(rain_rate_values(rain_att, length_km, f_hz / 1e9, pol, r_min=0.0))
    total = rain_att + waa
    if len(known) and known.max() > total[-1]:
        raise ValueError("attenuation is above the table")
    return np.where(np.isnan(a_obs), np.nan, np.interp(a_obs, total, waa))


def _from_observed(a_obs: Column, f_hz: Column, pol: Column, length_km: Column, waa_of) -> Column:
    @F.pandas_udf("double")
    def waa(a: pd.Series, f: pd.Series, p: pd.Series, length: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, a.index)
        for (one_f, one_p, one_l), part in a.groupby([f, p, length]):  # a table for each kind of sub-link
            out[part.index] = _inverse(part.to_numpy(float), one_f, one_p, one_l, lambda r: waa_of(r, one_f))
        return out

    return waa(a_obs.cast("double"), f_hz.cast("double"), pol, length_km.cast("double"))


def leijnse_from_observed(a_obs: Column, f_hz: Column, pol: Column, length_km: Column, **how) -> Column:
    """WAA after Leijnse et al. 2008 from observed attenuation; null gives null, negative values raise."""
    return _from_observed(a_obs, f_hz, pol, length_km, lambda r, f: leijnse_values(r, f, **how))


def pastorek_from_observed(a_obs: Column, f_hz: Column, pol: Column, length_km: Column, **how) -> Column:
    """WAA after Pastorek et al. 2021 from observed attenuation; null gives null, negative values raise."""
    return _from_observed(a_obs, f_hz, pol, length_km, lambda r, f: pastorek_values(r, **how))
