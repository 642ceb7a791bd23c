"""Tag predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The built-in stop lists that results depend on.
STOP_FRAGMENTS = "? 1 2 3 4 5 6 7 8 9 0 : # foto photo foursquare".split()
DEVICE_WORDS = (
    "light geotagged squareformat hdr foto photo olympus oculus instagramapp iphoneography "
    "monochrome biancoenero bw eos powershot macro photographer raw brashears iphone instagram "
    "olympus flickr canon nikon nikkor sony photo foto bb nightshot"
).split()
COMMON_WORDS = (
    "europe europa italy italia italien italie roma rom rome lazio romeitaly archivio arti "
    "contemporanee river english british centro popolo animali romanum olio trajan musica "
    "centrale romani romana roman tela leggera spagna mista rooma animals kri cb italians ruins "
    "politica uk european alessandro ritratti danza cosplay italian latinium architektur monumenti"
).split()
STOP_WORDS = sorted({*STOP_FRAGMENTS, *DEVICE_WORDS, *COMMON_WORDS})


def is_plain_word(tag: Column) -> Column:
    """True for tags made of ASCII letters only (the empty tag included).

    One pattern covers "no Han character, no digit, nothing but letters and
    digits". ``\\z`` rather than ``$``: the latter lets a trailing newline pass.
    """
    return tag.rlike(r"^[a-zA-Z]*\z")


def is_not_builtin_stop(
    tag: Column, words: list[str] = STOP_WORDS, fragments: list[str] = STOP_FRAGMENTS
) -> Column:
    """True for tags that are no built-in stop word and contain no stop fragment."""
    keep = ~tag.isin(words)
    for fragment in fragments:
        keep = keep & ~tag.contains(fragment)
    return keep
