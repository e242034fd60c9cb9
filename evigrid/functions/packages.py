"""Package names: styles, pin counts, hints in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Package styles, longest of a family first
STYLES = (
    "HTSSOP", "TSSOP", "VSSOP", "LQFP", "TQFP", "VQFP", "LFBGA", "TFBGA", "UFBGA", "VFBGA", "WLCSP", "LFCSP", "DSBGA",
    "HVQFN", "X2QFN", "WQFN", "UQFN", "VSON", "QFN", "XDFN", "UDFN", "VDFN", "DFN", "SOIC", "SSOP", "MSOP", "PDIP",
    "DIP", "BGA", "LGA", "CSP", "SON", "SOT", "QFP",
)
STYLE_GROUP = "|".join(STYLES)

# Fixed patterns
SUFFIX_COUNT = r"-(\d{1,4})\s*$"
STYLE_COUNT = rf"(?i)\b(?:{STYLE_GROUP})[\s\-_]*(\d{{1,4}})\b"
EXPOSED_PAD_NAME = r"(?i)^(?:EP(?:AD)?|EXPOSED\s*PAD)$"
EXPOSED_PAD_TEXT = r"(?i)exposed\s*pad|裸露焊盘|散热焊盘"


def plausible_count(value: Column) -> Column:
    """Lead counts: 3, 5, or an even number from 4 to 2000."""
    return value.isin(3, 5) | (value.between(4, 2000) & (value % 2 == 0))


def _plausible_or_null(text: Column) -> Column:
    # The filter reads the value once where a condition would repeat the pattern.
    return F.try_element_at(F.filter(F.array(text.try_cast("int")), plausible_count), F.lit(1))


def pin_count_from_package(package: str | Column) -> Column:
    """Pin count a package name carries: the -n suffix, then style and number, then a lone digit run."""
    text = F.trim(F.coalesce(F.col(package) if isinstance(package, str) else package, F.lit("")))
    run = F.when((F.regexp_count(text, F.lit(r"\d+")) == 1) & text.rlike(r"^[A-Za-z]") & (F.length(text) <= 12),
                 F.regexp_extract(text, r"(\d+)", 1))
    return F.coalesce(_plausible_or_null(F.regexp_extract(text, SUFFIX_COUNT, 1)),
                      _plausible_or_null(F.regexp_extract(text, STYLE_COUNT, 1)),
                      _plausible_or_null(run))


def exposed_pad_name(name: str = "name") -> Column:
    return F.coalesce(F.col(name), F.lit("")).rlike(EXPOSED_PAD_NAME)


def documented_exposed_pad(name: str = "name", description: str = "description") -> Column:
    """A pad name whose description says the same."""
    return exposed_pad_name(name) & F.coalesce(F.col(description), F.lit("")).rlike(EXPOSED_PAD_TEXT)
