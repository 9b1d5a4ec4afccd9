"""File-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reachlens.fixed_values import PUBLIC_URL_BASE

_LAST_SUFFIX = r"\.[^.]*$"


def stem_or_name(name: Column) -> Column:
    """Name without its last suffix; a name without a dot stays whole."""
    return F.regexp_replace(name, _LAST_SUFFIX, "")


def stem_or_empty(name: Column) -> Column:
    """Name without its last suffix; a name without a dot gives ""."""
    return F.when(F.contains(name, F.lit(".")), stem_or_name(name)).otherwise(F.lit(""))


def extension(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def renamed(file_id: Column, name: Column) -> Column:
    """The stored name of an upload: its id with the original suffix."""
    return F.concat(file_id, F.lit("."), extension(name))


def public_url(bucket: str, name: Column, base: str = PUBLIC_URL_BASE, quoted: bool = False) -> Column:
    """Address of an object; ``quoted`` percent-encodes its name as the store's own client does,
    all but letters, digits and ``/_.-~``."""
    if quoted:
        name = F.url_encode(name)  # as in forms, which differ in four characters
        for form, path in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
            name = F.replace(name, F.lit(form), F.lit(path))
    return F.concat(F.lit(f"{base}/{bucket}/"), name)


def major_type(mime: Column) -> Column:
    return F.split_part(mime, F.lit("/"), F.lit(1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
