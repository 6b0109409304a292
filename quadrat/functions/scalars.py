"""Scalar expressions.  Every one takes columns and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the three classes, from low to high.
LABELS = ("bad", "moderate", "good")
INSUFFICIENT = "insufficient_data"
#: Short names of the eleven indices.
SHORT = {
    "Acoustic_Complexity_Index__mean": "ACI",
    "Acoustic_Diversity_Index__main_value": "ADI",
    "Acoustic_Evenness_Index__main_value": "AEI",
    "Bio_acoustic_Index__main_value": "Bioacoustic",
    "Normalized_Difference_Sound_Index__main_value": "NDSI",
    "Spectral_Entropy__main_value": "Spectral Entropy",
    "Temporal_Entropy__main_value": "Temporal Entropy",
    "NB_peaks__main_value": "NB peaks",
    "Acoustic_Diversity_Index_NR__main_value": "ADI (NR)",
    "Bio_acoustic_Index_NR__main_value": "Bioacoustic (NR)",
    "Spectral_Entropy_NR__main_value": "Spectral Entropy (NR)",
}
_BLANKS = r"(?U)^\s+|\s+$"


def lenient_double(text: Column) -> Column:
    """The number a text holds, or null; ANSI casts would fail the query instead."""
    return text.try_cast("double")


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def skip_nan(x: Column) -> Column:
    """x, or null if it is NaN: what a mean has to skip.  Infinities stay."""
    return F.nanvl(x, F.lit(None).cast("double"))


def snap(degrees: Column, cells_per_degree: int = 10) -> Column:
    """Index of the grid cell along one axis (floor, so that negative degrees go down)."""
    return F.floor(finite(degrees) * F.lit(float(cells_per_degree))).cast("bigint")


def cell_center(corner: Column, cell: float = 0.1, places: int = 4) -> Column:
    return F.round(corner + F.lit(cell / 2), places)


def lat_band(corner: Column, degrees: int = 10) -> Column:
    return (F.floor(corner / F.lit(float(degrees))) * degrees).cast("int")


def year_text(date: Column) -> Column:
    """First four characters if they are ASCII digits, else null.  No range is applied."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4))


def year_between(date: Column, first: int, last: int) -> Column:
    """The year as a number if it is in the range, else null."""
    year = F.substring(date, 1, 4).try_cast("int")
    return F.when(year.between(first, last), year)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def species_key(genus: Column, species: Column) -> Column:
    """'Genus species' without outer blanks; null if nothing is left."""
    blank = F.lit("")
    return F.nullif(_stripped(F.concat_ws(" ", F.coalesce(genus, blank), F.coalesce(species, blank))), blank)


def species_set(genus: Column, species: Column, also: Column) -> Column:
    """Distinct names of a record: its own and those of its ';'-list.  Empty if there are none."""
    listed = F.filter(F.transform(F.split(F.coalesce(also, F.lit("")), ";"), _stripped), lambda x: x != "")
    return F.array_distinct(F.concat(F.array_compact(F.array(species_key(genus, species))), listed))


def list_text(value: Column) -> Column:
    """A JSON list of texts joined by ';'; any other text as it is."""
    return F.coalesce(F.array_join(F.from_json(F.when(value.startswith("["), value), "array<string>"), ";"), value)


def label_code(label: Column) -> Column:
    code = F.lit(None).cast("int")
    for k, name in enumerate(LABELS):
        code = F.when(label == name, k).otherwise(code)
    return code


def direction(delta: Column, threshold: float = 0.5) -> Column:
    return F.when(delta > threshold, "up").when(delta < -threshold, "down").when(delta.isNotNull(), "flat")


def percent(part: Column, whole: Column, places: int | None = 1) -> Column:
    value = F.try_divide(part * F.lit(100.0), whole)
    return value if places is None else F.round(value, places)


def growth(first: Column, last: Column) -> Column:
    """Whole percent of growth, rounded down; null if there was nothing at first."""
    return F.floor(F.try_divide((last - first) * F.lit(100.0), first)).cast("bigint")


def short_name(index: Column) -> Column:
    """The short name of an index, or the name itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair]), index), index)
