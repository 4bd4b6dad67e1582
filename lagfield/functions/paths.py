"""File-name expressions."""

from pyspark.sql import functions as F

# The endings that mark a correlation map and its uncertainty map.
CORRELATION_SUFFIX = "_RICScorr"
UNCERTAINTY_SUFFIX = "_RICSunc"


def base_name(path):
    """The text after the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path):
    """The text before the last slash."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path):
    """The ending with its dot; a leading dot is part of the name."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path):
    """The file name without its extension."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def prefix(name):
    """The text before the first underscore, which names the metadata document."""
    return F.split(name, "_", 2)[0]


def partner_name(name):
    """Name of the uncertainty map that belongs to a correlation map."""
    return F.regexp_replace(name, CORRELATION_SUFFIX, UNCERTAINTY_SUFFIX)
