"""Replay of a log of edits on decks: insert, delete, move and rename, in order, into final places and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLIDE = "struct<origin:string,slug:string>"


def _stem(position: Column, slug: Column) -> Column:
    return F.concat(F.format_string("%02d", position), F.lit("-slide-"), slug)


def _after(slides: Column, e: Column) -> Column:
    """The slides after one edit; null for an edit that cannot be done: a slug that is there already, or one that is not."""
    at = F.array_position(F.transform(slides, lambda s: s["slug"]), e["slug"])
    there, rest = at > 0, F.filter(slides, lambda s: s["slug"] != e["slug"])
    put = lambda into, slide: F.array_insert(into, F.greatest(F.lit(1), F.least(e["position"], F.size(into) + 1)).cast("int"), slide)
    new = F.struct(F.lit(None).cast("string").alias("origin"), e["slug"].alias("slug"))
    free = e["new_slug"].isNotNull() & ~F.coalesce(F.array_contains(F.transform(rest, lambda s: s["slug"]), e["new_slug"]), F.lit(False))
    renamed = F.transform(slides, lambda s: F.struct(s["origin"].alias("origin"), F.when(s["slug"] == e["slug"], e["new_slug"]).otherwise(s["slug"]).alias("slug")))
    return (
        F.when((e["op"] == "insert") & ~there & e["position"].isNotNull(), put(slides, new))
        .when((e["op"] == "delete") & there, rest)
        .when((e["op"] == "move") & there & e["position"].isNotNull(), put(rest, F.get(slides, F.greatest(at - 1, F.lit(0)).cast("int"))))
        .when((e["op"] == "rename") & there & free, renamed)
    )


def replayed(slides: DataFrame, edits: DataFrame) -> DataFrame:
    """deck_id, before (array of slugs), slides (array of SLIDE, in order), ignored (steps that could not be done).

    slides: deck_id, position, slug (unique in a deck); edits: deck_id, step, op, slug, position, new_slug. A place is that of the moment
    of the edit, from 1, and counts to the nearest there is. One row holds a deck and its log. Edits of decks without slides start from none.
    """
    own = slides.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("position", "slug"))).alias("s"))
    logs = edits.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("step", "op", "slug", "position", "new_slug"))).alias("log"))
    rows = own.join(logs, "deck_id", "full")
    before = F.coalesce(F.transform("s", lambda x: x["slug"]), F.array().cast("array<string>"))
    start = F.struct(F.transform(before, lambda x: F.struct(x.alias("origin"), x.alias("slug"))).alias("slides"), F.array().cast("array<long>").alias("ignored"))
    log = F.coalesce("log", F.array().cast("array<struct<step:long,op:string,slug:string,position:long,new_slug:string>>"))

    def step(state: Column, e: Column) -> Column:
        done = F.transform(F.array(_after(state["slides"], e)), lambda n: F.struct(F.coalesce(n, state["slides"]).alias("slides"), F.when(n.isNull(), F.array_append(state["ignored"], e["step"].cast("long"))).otherwise(state["ignored"]).alias("ignored")))
        return F.element_at(done, 1)

    return rows.select("deck_id", before.alias("before"), F.aggregate(log, start, step).alias("r")).select("deck_id", "before", "r.*")


def file_changes(decks: DataFrame) -> DataFrame:
    """deck_id, action (keep, rename, create, remove), old_stem, new_stem of each slide of ``replayed`` decks. Slugs stay, numbers follow places."""
    old = F.transform("before", lambda s, i: F.struct(s.alias("origin"), _stem(i + 1, s).alias("stem")))
    new = F.transform("slides", lambda s, i: F.struct(s["origin"].alias("origin"), _stem(i + 1, s["slug"]).alias("stem")))
    was = lambda o: F.get(F.filter(old, lambda x: x["origin"] == o), F.lit(0))["stem"]
    kept = F.transform(new, lambda n: F.struct(was(n["origin"]).alias("old_stem"), n["stem"].alias("new_stem")))
    gone = F.filter(old, lambda x: ~F.exists("slides", lambda s: s["origin"].eqNullSafe(x["origin"])))
    lost = F.transform(gone, lambda x: F.struct(x["stem"].alias("old_stem"), F.lit(None).cast("string").alias("new_stem")))
    rows = decks.select("deck_id", F.explode(F.concat(kept, lost)).alias("f")).select("deck_id", "f.*")
    action = F.when(F.col("new_stem").isNull(), "remove").when(F.col("old_stem").isNull(), "create").when(F.col("old_stem") == F.col("new_stem"), "keep").otherwise("rename")
    return rows.select("deck_id", action.alias("action"), "old_stem", "new_stem")


def ignored_edits(decks: DataFrame) -> DataFrame:
    """deck_id, step of edits that could not be done."""
    return decks.select("deck_id", F.explode("ignored").alias("step"))
