"""URL columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_URL_BYTES = 10
SCHEMES = ("http://", "https://")
SEED_URL = "https://en.wikipedia.org/wiki/Main_Page"


def is_valid_url(url: Column) -> Column:
    """Case-sensitive scheme test and a minimum length in bytes; NULL is invalid."""
    has_scheme = url.startswith(SCHEMES[0]) | url.startswith(SCHEMES[1])
    return F.coalesce((F.octet_length(url) >= MIN_URL_BYTES) & has_scheme, F.lit(False))
