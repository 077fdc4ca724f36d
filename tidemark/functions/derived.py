"""Derived features as column expressions, by family; a family is added only if all its inputs are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names and formulas of the derived features below.
EPS = 1e-12


def _positive(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def sun(b: Column, a: Column, lag) -> dict[str, Column]:
    return {
        "sun_log_flux_ratio": F.log(F.abs(b) + EPS) - F.log(F.abs(a) + EPS),
        "sun_xrsb_diff_10m": b - lag(b, 10),
        "sun_xrsa_diff_10m": a - lag(a, 10),
        "sun_xrs_sum_flux": b + a,
        "sun_xrs_hardness_proxy": b / (F.abs(a) + EPS),
    }


def l1(by: Column, bz: Column, bt: Column, v: Column, p: Column) -> dict[str, Column]:
    clock = F.atan2(by, bz)
    transverse = F.sqrt(by * by + bz * bz)
    return {
        "l1_clock_angle_rad": clock,
        "l1_newell_like": F.pow(_positive(v), 4 / 3) * F.pow(transverse, 2 / 3) * F.pow(F.abs(F.sin(F.abs(clock) / 2)), 8 / 3),
        "l1_dynamic_pressure_speed": p * v,
        "l1_bmag_pressure_ratio": bt / (F.abs(p) + EPS),
        "l1_electric_field_proxy": v * F.abs(bz),
    }


def geo(bx: Column, by: Column, bz: Column, bz_vdh: Column, lag) -> dict[str, Column]:
    return {
        "geo_bz_minus_vdh": bz - bz_vdh,
        "geo_b_transverse_gsm": F.sqrt(bx * bx + by * by),
        "geo_b_transverse_vdh_proxy": F.abs(bz) + F.abs(bz_vdh),
        "geo_bz_gsm_diff_15m": bz - lag(bz, 15),
        "geo_bz_vdh_diff_15m": bz_vdh - lag(bz_vdh, 15),
    }


def leo(north: Column, east: Column, centre: Column, sza: Column, freshness: Column, lag) -> dict[str, Column]:
    horizontal = F.sqrt(north * north + east * east)
    return {
        "leo_fac_cond_proxy": north / (1 + F.abs(sza)),
        "leo_residual_horizontal_mag": horizontal,
        "leo_residual_vertical_to_horizontal_ratio": F.abs(centre) / (F.abs(horizontal) + EPS),
        "leo_north_diff_10m": north - lag(north, 10),
        "leo_freshness_weighted_residual": north / (1 + F.abs(freshness)),
    }


#: Inputs of each family, in the order of its function's arguments.
INPUTS = {
    "sun": ["xrs_xrsb_flux", "xrs_xrsa_flux"],
    "l1": ["omni_by_gsm_nt", "omni_bz_gsm_nt", "omni_bt_nt", "omni_speed_km_s", "omni_flow_pressure_npa"],
    "geo": ["goes_mag_b_gsm_x", "goes_mag_b_gsm_y", "goes_mag_b_gsm_z", "goes_mag_b_vdh_z"],
    "leo": ["swarm_residual_north_nt", "swarm_residual_east_nt", "swarm_residual_center_nt", "sza_deg", "swarm_freshness_min"],
}
FAMILIES = {"sun": (sun, True), "l1": (l1, False), "geo": (geo, True), "leo": (leo, True)}


def derived_columns(names: Sequence[str], lag, inputs: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """The derived columns of each family whose inputs are among ``names``; ``lag(column, rows)`` is the lag to use."""
    out: dict[str, Column] = {}
    for name, columns in (inputs or INPUTS).items():
        if all(c in names for c in columns):
            make, lagged = FAMILIES[name]
            out |= make(*[F.col(c) for c in columns], *([lag] if lagged else []))
    return out


def add_derived(df: DataFrame, lag, inputs: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with its ``derived_columns``."""
    return df.withColumns(derived_columns(df.columns, lag, inputs))
