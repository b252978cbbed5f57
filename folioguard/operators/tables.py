"""Result tables of slides, as HTML and as rows of a native table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.functions import text as H

TABLE = "caption STRING, footnote STRING, row_header BOOLEAN, columns ARRAY<VARIANT>, rows ARRAY<ARRAY<VARIANT>>"
TABLE_STRUCT = "STRUCT<" + TABLE.replace(" ", ": ").replace(",: ", ", ") + ">"


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _value(cell: Column) -> Column:
    return F.coalesce(F.when(_object(cell), F.try_variant_get(cell, "$.v", "string")).otherwise(F.try_variant_get(cell, "$", "string")), F.lit(""))


def _bold(cell: Column) -> Column:
    return F.coalesce(F.try_variant_get(cell, "$.bold", "boolean"), F.lit(False)) & _object(cell)


def _label(c: Column) -> Column:
    return F.coalesce(F.when(_object(c), F.try_variant_get(c, "$.label", "string")).otherwise(F.try_variant_get(c, "$", "string")), F.lit(""))


def _unit(c: Column) -> Column:
    return F.coalesce(F.when(_object(c), F.try_variant_get(c, "$.unit", "string")), F.lit(""))


def parsed(table: Column) -> Column:
    """struct<TABLE> of a table's JSON; null unless it has columns and rows."""
    t = F.from_json(table, TABLE)
    return F.when(t["columns"].isNotNull() & t["rows"].isNotNull(), t)


def html_of(t: Column) -> Column:
    """HTML of a struct<TABLE>: units in the header, bold cells strong, roomy up to 6 rows and 5 columns; null unless it has columns and rows."""
    text = lambda tag, s: F.concat(F.lit(f"<{tag}>"), s, F.lit(f"</{tag}>"))
    head = lambda c: text("th", F.concat(H.escape_html(_label(c)), F.when(_unit(c) != "", F.concat(F.lit('<span class="u">'), H.escape_html(_unit(c)), F.lit("</span>"))).otherwise("")))

    def cell(c: Column, i: Column) -> Column:
        inner = H.escape_html(_value(c))
        inner = F.when(_bold(c), text("strong", inner)).otherwise(inner)
        return F.when(F.coalesce(t["row_header"], F.lit(False)) & (i == 0), text("th", inner)).otherwise(text("td", inner))

    row = lambda r: text("tr", F.array_join(F.transform(r, cell), ""))
    n = F.size(t["columns"])
    some = lambda c, a, b: F.when(F.coalesce(t[c], F.lit("")) != "", F.concat(a, H.escape_html(t[c]), b)).otherwise("")
    html = F.concat(
        F.when((F.size(t["rows"]) <= 6) & (n <= 5), '<table class="results roomy">').otherwise('<table class="results">'),
        some("caption", F.lit("<caption>"), F.lit("</caption>")),
        text("thead", text("tr", F.array_join(F.transform(t["columns"], head), ""))),
        text("tbody", F.array_join(F.transform(t["rows"], row), "")),
        some("footnote", F.concat(F.lit('<tfoot><tr><td colspan="'), n.cast("string"), F.lit('">')), F.lit("</td></tr></tfoot>")),
        F.lit("</table>"),
    )
    return F.when(t["columns"].isNotNull() & t["rows"].isNotNull(), html)


def as_html(tables: DataFrame) -> DataFrame:
    """table_id, html of tables (table_id, spec JSON); html is null for malformed ones, see ``html_of``."""
    return tables.select("table_id", html_of(F.from_json("spec", TABLE)).alias("html"))


def table_rows(tables: DataFrame) -> DataFrame:
    """table_id, row (0: header), col, text, bold, align of tables (table_id, spec JSON); malformed ones give no rows.

    Units stand in brackets in the header, which is bold and centred; a row header column is aligned to the left, other cells to the right.
    """
    rows = tables.select("table_id", parsed(F.col("spec")).alias("t")).where("t IS NOT NULL")
    cell = lambda text, bold, align: F.struct(text.alias("text"), bold.alias("bold"), align.alias("align"))
    head = F.transform("t.columns", lambda c: cell(F.concat(_label(c), F.when(_unit(c) != "", F.concat(F.lit(" ("), _unit(c), F.lit(")"))).otherwise("")), F.lit(True), F.lit("center")))
    left = lambda i: F.when(F.coalesce(F.col("t.row_header"), F.lit(False)) & (i == 0), "left").otherwise("right")
    body = F.transform("t.rows", lambda r: F.transform(r, lambda c, i: cell(_value(c), _bold(c), left(i))))
    each = rows.select("table_id", F.posexplode(F.concat(F.array(head), body)).alias("row", "cells"))
    return each.select("table_id", "row", F.posexplode("cells").alias("col", "c")).select("table_id", "row", "col", "c.*")
