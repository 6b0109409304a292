"""Column builders: plain expressions that stay inside whole-stage code generation."""

from .aggregates import rarefied
from .geometry import in_rings
from .scalars import (
    cell_center, direction, finite, growth, label_code, lat_band, lenient_double, list_text, percent, short_name, skip_nan, snap, species_key, species_set, year_between, year_text,
)

__all__ = [
    "cell_center", "direction", "finite", "growth", "in_rings", "label_code", "lat_band", "lenient_double", "list_text", "percent",
    "rarefied", "short_name", "skip_nan", "snap", "species_key", "species_set", "year_between", "year_text",
]
