"""Paths relative to a root, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, root: str) -> Column:
    """The part of a file URI below ``root``; empty when it is not below it."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/{0,2}", "", root).strip("/")
    return F.regexp_extract(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), rf"(?:^|/)\Q{bare}\E/(.*)$", 1)


def first_part(rel: Column) -> Column:
    return F.substring_index(rel, "/", 1)


def file_name(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)
