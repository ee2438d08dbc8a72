"""JSON arrays too large for a row, cut into their elements.

A file is read as the pieces between its commas, by as many tasks as it has splits. What
a piece does to a reader is a small function: it flips "inside a string" by its number
of quotes, and changes the depth by one amount if it begins outside a string and by another
if inside. Running sums over the pieces, carried over the splits, give the state
at every comma; those outside strings at depth one part the elements. Only an element
has to fit a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import scan
from ..session import stage
from .paths import relative_path

PLACE = ("block", "pos")


def read_pieces(spark: SparkSession, root: str, names: str = "*.{txt,json,gz,TXT,JSON,GZ}") -> DataFrame:
    """(path, block, pos, piece) of the files below ``root``: a row for each stretch between two commas; staged."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("lineSep", ",").text(root)
        .select(
            relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"), F.col("value").alias("piece"),
        )
    )
    return stage(raw, "pieces")  # the generated order must not change between its uses


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _depth(unquoted: Column) -> Column:
    return _count(unquoted, "[{") - _count(unquoted, "]}")


def _states(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, pos, quoted, depth, part): the state after each piece, and the element it belongs to."""
    plain = F.regexp_replace("piece", r"(?s)\\.", "")  # escapes stand in strings only, and none spans a comma
    strings = r'"[^"]*("|$)'
    outside = F.regexp_replace(F.col("_plain"), strings, "")
    inside = F.regexp_replace(F.regexp_replace(F.col("_plain"), r'^[^"]*("|$)', ""), strings, "")
    effects = pieces.select(*keys, *PLACE, plain.alias("_plain")).select(
        *keys, *PLACE, _count(F.col("_plain"), '"').cast("bigint").alias("_quotes"),
        _depth(outside).cast("bigint").alias("_outside"), _depth(inside).cast("bigint").alias("_inside"),
    )
    quoted = scan(stage(effects, "effects"), keys, PLACE, {"_upto": ("sum", F.col("_quotes"))}, "block")
    change = F.when((F.col("_upto") - F.col("_quotes")) % 2 == 1, F.col("_inside")).otherwise(F.col("_outside"))
    changes = stage(quoted.select(*keys, *PLACE, (F.col("_upto") % 2 == 1).alias("quoted"), change.alias("_change")), "changes")
    deep = scan(changes, keys, PLACE, {"depth": ("sum", F.col("_change"))}, "block")
    ends = ~F.col("quoted") & (F.col("depth") == 1)
    marked = stage(deep.select(*keys, *PLACE, "quoted", "depth", ends.cast("bigint").alias("_ends")), "states")
    return scan(marked, keys, PLACE, {"_part": ("sum", F.col("_ends"))}, "block").select(
        *keys, *PLACE, "quoted", "depth", (F.col("_part") - F.col("_ends")).alias("part")
    )


def array_elements(pieces: DataFrame, keys: Sequence[str] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """(elements, files) of JSON arrays given as pieces between commas.

    ``elements`` has the keys, `part` (from 0) and `text`, one row per element.
    ``files`` has the keys, `elements`, `bytes` and `well_formed`: the file is one
    array, and every element of it parses. An empty array has no elements.
    """
    keys = list(keys)
    states = stage(_states(pieces, keys), "elements")
    first = F.min(F.struct(*PLACE))
    last = F.max_by(F.struct("quoted", "depth", "part"), F.struct(*PLACE))
    early = F.count_if(F.col("depth") <= 0)  # only the last piece may close the array
    shape = states.groupBy(*keys).agg(last.alias("_last"), first.alias("_first"), early.alias("_early"))
    placed = pieces.join(states.select(*keys, *PLACE, "part"), [*keys, *PLACE])
    texts = placed.groupBy(*keys, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*PLACE, "piece"))), lambda p: p["piece"]), ",").alias("_text")
    )
    joined = texts.join(shape, keys)
    opens, closes = F.col("part") == 0, F.col("part") == F.col("_last.part")
    bare = F.regexp_replace("_text", r"^\s+|\s+$", "")
    begun = F.when(opens, F.regexp_replace(bare, r"^\[", "")).otherwise(bare)
    ended = F.when(closes, F.regexp_replace(begun, r"\]$", "")).otherwise(begun)
    framed = (~opens | bare.startswith("[")) & (~closes | bare.endswith("]"))
    text = F.regexp_replace(ended, r"^\s+|\s+$", "")
    alone = opens & closes
    cut = joined.select(*keys, "part", "_last", "_early", framed.alias("_framed"), text.alias("text"), alone.alias("_alone"))
    cut = stage(cut, "cut")
    empty = F.col("_alone") & (F.col("text") == "")
    valid = F.col("_framed") & (empty | F.try_parse_json("text").isNotNull())
    whole = F.every(valid) & F.every((F.col("_last.depth") == 0) & ~F.col("_last.quoted") & (F.col("_early") == 1))
    size = pieces.groupBy(*keys).agg((F.sum(F.octet_length("piece") + 1) - 1).alias("bytes"))
    files = cut.groupBy(*keys).agg(F.count_if(~empty).alias("elements"), whole.alias("well_formed")).join(size, keys)
    return cut.where(~empty).select(*keys, "part", "text"), files.select(*keys, "elements", "bytes", "well_formed")
