"""Places on a page that shows one figure: title lines above, the figure in a framed box, caption lines below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.operators.deck import contain_scale, wrapped

# Sizes on a page 1920 wide, line heights, and shares of the page that title, figure and caption may take.
BASE_WIDTH = 1920
TITLE_Y, TITLE_FONT, TITLE_LEADING, TITLE_SHARE = 80, 48, 1.3, 0.9
CAPTION_FONT, CAPTION_LEADING, CAPTION_SHARE, BOTTOM = 24, 1.4, 0.85, 80
FIGURE_W, FIGURE_H, PADDING = 0.85, 0.65, 20
#: Mean width of a character in terms of the font's size, in place of measuring it.
CHARACTER = 0.5


def _lines(text: Column, font: Column, width: Column, character: float) -> Column:
    return wrapped(text, F.floor(width / (font * character)).cast("int"))


def template_places(pages: DataFrame, character: float = CHARACTER) -> DataFrame:
    """page_id, title_font, caption_font, titles and captions (array<struct<text, y>>, y of the line's middle), figure and frame (struct<x, y, w, h>).

    pages: page_id, title, caption, figure_w, figure_h, width, height. The figure is as large as fits between title and caption, and centred there; pages
    whose title leaves no room, and pictures without an area, have null boxes. Text is centred in x.
    """
    scale = F.col("width") / BASE_WIDTH
    sized = lambda v: F.floor(F.lit(v) * scale + 0.5)
    rows = pages.withColumns({"title_font": sized(TITLE_FONT), "caption_font": sized(CAPTION_FONT), "pad": sized(PADDING), "top": sized(TITLE_Y), "caption_y": F.col("height") - sized(BOTTOM)})
    rows = rows.withColumns({
        "t": _lines(F.col("title"), F.col("title_font"), TITLE_SHARE * F.col("width"), character),
        "c": _lines(F.col("caption"), F.col("caption_font"), CAPTION_SHARE * F.col("width"), character),
    })
    rows = rows.withColumn("below", F.col("top") + F.size("t") * F.col("title_font") * TITLE_LEADING + F.col("pad") * 2)
    rows = rows.withColumn("room", F.col("caption_y") - F.col("below") - F.col("pad") * 2)
    most = F.least(F.col("height") * FIGURE_H, F.col("room"))
    rows = rows.withColumn("s", F.when(most > 0, contain_scale(F.col("figure_w"), F.col("figure_h"), F.col("width") * FIGURE_W, most)))
    rows = rows.withColumns({"w": F.col("figure_w") * F.col("s"), "h": F.col("figure_h") * F.col("s")})
    rows = rows.withColumns({"x": (F.col("width") - F.col("w")) / 2, "y": F.col("below") + (F.col("room") - F.col("h")) / 2})
    box = lambda x, y, w, h: F.when(F.col("s").isNotNull(), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))
    placed = lambda lines, y, font, leading: F.transform(lines, lambda s, i: F.struct(s.alias("text"), (F.col(y) + i * F.col(font) * leading).cast("double").alias("y")))
    x, y, w, h, pad = (F.col(n) for n in ("x", "y", "w", "h", "pad"))
    return rows.select(
        "page_id", "title_font", "caption_font", placed("t", "top", "title_font", TITLE_LEADING).alias("titles"), placed("c", "caption_y", "caption_font", CAPTION_LEADING).alias("captions"),
        box(x, y, w, h).alias("figure"), box(x - pad, y - pad, w + 2 * pad, h + 2 * pad).alias("frame"),
    )
