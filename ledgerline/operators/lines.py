"""Structure of register pages: headings, house numbers, indents, merged lines, and headings carried forward.

Lines are rows (page_idx, col_idx, line_idx, content, coords, number, street, linetype). Tags are set in the order
names, numbers, indents; it matters, since a heading that starts with digits ends up as a numbered entry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import min_x, points, rotated_sides
from ..functions.text import leading_number, without
from ..sources.staging import staged
from .match import best_matches
from .scans import forward_fill, medians

ENTRY, INDENTED, NUMBERED, STREET = "ENTRY", "INDENTED_ENTRY", "ENTRY_WITH_STREETNUMBER", "STREETNAME"
COLUMN = ["page_idx", "col_idx"]
ORDER = [*COLUMN, "line_idx"]


def measured(lines: DataFrame) -> DataFrame:
    """Adds minx and bbox_height (the shorter side of the least rotated rectangle) from coords, once; untagged lines are entries."""
    empty = {c: F.lit(None).cast("string") for c in ("number", "street") if c not in lines.columns}
    kind = {} if "linetype" in lines.columns else {"linetype": F.lit(ENTRY)}
    return lines.withColumns({"minx": min_x(points("coords")), "bbox_height": rotated_sides(points("coords"))["width"], **empty, **kind})


def tag_street_names(lines: DataFrame, streets: DataFrame | None = None, inflate_std: float = 3, cutoff: float = 0.5) -> DataFrame:
    """Lines higher than their column's mean + inflate_std population deviations are headings.

    With a list of streets (one column) the heading becomes its best match there, and without one it is none.
    """
    column = Window.partitionBy(*COLUMN)
    high = F.col("bbox_height") > F.avg("bbox_height").over(column) + inflate_std * F.stddev_pop("bbox_height").over(column)
    tall = lines.withColumn("__name", F.when(high, F.col("content")))
    if streets is not None:
        found = best_matches(tall.filter("__name is not null"), "__name", streets, streets.columns[0], cutoff).select(F.col("query").alias("__query"), F.col("match").alias("__match"))
        tall = tall.join(found, F.col("__name") == F.col("__query"), "left").withColumn("__name", F.col("__match")).drop("__query", "__match")
    is_name = F.coalesce(F.length("__name") > 0, F.lit(False))
    return tall.withColumns({"linetype": F.when(is_name, STREET).otherwise(F.col("linetype")), "street": F.when(is_name, F.col("__name")).otherwise(F.col("street"))}).drop("__name")


def correct_street_names(lines: DataFrame, fixes: DataFrame, streets: DataFrame | None = None, cutoff: float = 0.75) -> DataFrame:
    """Manual headings: fixes are (page_idx, col_idx, line_idx, name); a NULL or empty name takes the line's content.

    With a list of streets (one column) the heading becomes its best match there, and stays as it is without one.
    """
    named = lines.join(fixes.withColumn("__fix", F.lit(True)), ORDER, "left").withColumn("name", F.when(F.col("__fix"), F.coalesce(F.nullif("name", F.lit("")), "content")))
    if streets is not None:
        found = best_matches(named, "name", streets, streets.columns[0], cutoff).select(F.col("query").alias("__query"), F.col("match").alias("__match"))
        named = named.join(found, F.col("name") == F.col("__query"), "left").withColumn("name", F.coalesce("__match", "name")).drop("__query", "__match")
    return named.withColumns({"street": F.when(F.col("__fix"), F.col("name")).otherwise(F.col("street")), "linetype": F.when(F.col("__fix"), STREET).otherwise(F.col("linetype"))}).drop("name", "__fix")


def tag_street_numbers(lines: DataFrame) -> DataFrame:
    """Lines with a leading number become numbered entries; the number is taken out of the content wherever it occurs."""
    number = leading_number("content")
    found = lines.withColumn("__number", number)
    return found.withColumns({
        "linetype": F.when(F.col("__number").isNotNull(), NUMBERED).otherwise(F.col("linetype")),
        "number": F.coalesce("__number", "number"),
        "content": without("content", "__number"),
    }).drop("__number")


def tag_indented(lines: DataFrame, inflate_std: float = 1, ignore_nonstd_lines: bool = False) -> DataFrame:
    """Entries that start right of their column's median + inflate_std population deviations are indented.

    ignore_nonstd_lines leaves numbered entries and headings out of the measure and untouched.
    """
    counted = ~F.col("linetype").isin(NUMBERED, STREET) if ignore_nonstd_lines else F.lit(True)
    spread = lines.filter(counted).groupBy(*COLUMN).agg(F.stddev_pop("minx").alias("__spread"))
    limits = spread.join(medians(lines.filter(counted), COLUMN, "minx", "__median"), COLUMN).select(*COLUMN, (F.col("__median") + inflate_std * F.col("__spread")).alias("__limit"))
    limits = staged(limits)  # its size is known then, so few columns, which may hold all lines, do not have these meet by column
    right = counted & F.col("linetype").isin(ENTRY, NUMBERED) & (F.col("minx") > F.col("__limit"))
    return lines.join(limits, COLUMN, "left").withColumn("linetype", F.when(right, INDENTED).otherwise(F.col("linetype"))).drop("__limit")


def piece(content: Column) -> Column:
    """A line's text as part of a merged one: a blank follows unless it ends in a hyphen, which stays."""
    return F.when(content.endswith("⸗") | content.endswith("-"), content).otherwise(F.concat(content, F.lit(" ")))


def merge_indented(lines: DataFrame, preserve_empty_headers: bool = False) -> DataFrame:
    """Append each run of indented lines to the line before it; one row per line that isn't indented.

    Empty lines go first, and with them a numbered line that was nothing but its number, unless preserve_empty_headers.
    Indented lines at the top of a column belong to nothing and are lost; lost_indents counts them.
    """
    full = F.col("content") != ""
    if preserve_empty_headers:
        full = full | F.col("number").isNotNull()
    head = F.col("linetype") != INDENTED
    order = Window.partitionBy(*COLUMN).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    groups = lines.filter(full).withColumn("__group", F.sum(F.when(head, 1).otherwise(0)).over(order)).filter("__group > 0")
    parts = F.sort_array(F.collect_list(F.struct("line_idx", piece(F.col("content")).alias("p"))))
    kept = [c for c in lines.columns if c not in (*COLUMN, "line_idx", "content")]
    merged = groups.groupBy(*COLUMN, "__group").agg(
        F.min("line_idx").alias("line_idx"), F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("content"),
        *(F.min_by(F.struct(F.col(c)), "line_idx")[c].alias(c) for c in kept),
    )
    return merged.drop("__group").select(*lines.columns)


def lost_indents(lines: DataFrame) -> DataFrame:
    """(page_idx, col_idx, lost): indented lines above the first other line of their column."""
    full = lines.filter("content <> ''")
    head = full.groupBy(*COLUMN).agg(F.min(F.when(F.col("linetype") != INDENTED, F.col("line_idx"))).alias("__first"))
    return full.join(head, COLUMN).groupBy(*COLUMN).agg(F.count_if(F.col("__first").isNull() | (F.col("line_idx") < F.col("__first"))).alias("lost"))


def distribute_addresses(lines: DataFrame) -> DataFrame:
    """Street and number of the last line that had them, over columns and pages; '' before the first.

    A heading sets the street, a number of its own sets the number; neither is reset at a new street or column.
    A heading keeps its own number.
    """
    own = lines.withColumns({
        "__street": F.when((F.col("linetype") == STREET) & (F.coalesce("street", F.lit("")) != ""), F.col("street")),
        "__number": F.when((F.col("linetype") == NUMBERED) & (F.coalesce("number", F.lit("")) != ""), F.col("number")),
    })
    filled = forward_fill(own, ["__street", "__number"], ORDER, "")
    heading = F.col("linetype") == STREET
    return filled.withColumns({"street": F.when(heading, F.coalesce("street", "__street")).otherwise(F.col("__street")), "number": F.when(heading, F.col("number")).otherwise(F.col("__number"))}).drop("__street", "__number")


def structured(
    lines: DataFrame, streets: DataFrame | None = None, fixes: DataFrame | None = None,
    names: Mapping[str, object] | None = None, indents: Mapping[str, object] | None = None, preserve_empty_headers: bool = False,
) -> DataFrame:
    """All steps, in their order. names and indents: settings of tag_street_names and tag_indented other than their defaults."""
    named = tag_street_names(measured(lines), streets, **(names or {}))
    tagged = tag_indented(tag_street_numbers(named), **(indents or {}))
    merged = merge_indented(tagged, preserve_empty_headers)
    return distribute_addresses(correct_street_names(merged, fixes) if fixes is not None else merged)
