"""Import every catalog module so that its queries register."""

from catalog import charts, clean, density, encode, impute, join, kpi, models, profile, relate, series  # noqa: F401
