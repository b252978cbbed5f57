"""Crowded pages and near titles against plain loops over all pairs."""

import difflib
import random
import re

import pytest

from folioguard.operators import bib as B
from folioguard.operators import geometry as G

BOX = "x0 double, y0 double, x1 double, y1 double"
CAPTION = f"page_id long, caption_id long, kind string, {BOX}, page_h double"


def grown(kind, cap, rects, h, gap=0.038):
    x0, y0, x1, y1 = cap
    edge = y0 if kind == "figure" else y1
    g, pool = [x0, edge, x1, edge], [r for r in rects if (r[3] <= y0 + 2 if kind == "figure" else r[1] >= y1 - 2)]
    moved = True
    while moved:
        new = list(g)
        for r in pool:
            if min(new[2], r[2]) - max(new[0], r[0]) > 0 and max(new[1], r[1]) - min(new[3], r[3]) <= gap * h:
                new = [min(new[0], r[0]), min(new[1], r[1]), max(new[2], r[2]), max(new[3], r[3])]
        moved, g = new != g, new
    if kind == "figure":
        g = [g[0], g[1], g[2], min(g[3], y0)] if g[1] < y0 - 1 else None
    else:
        g = [g[0], max(g[1], y1), g[2], g[3]] if g[3] > y1 + 1 else None
    return tuple(g) if g and g[3] - g[1] <= (0.85 if kind == "figure" else 0.5) * h else (None,) * 4


def pages(seed, n_pages, n_rects, width=40.0):
    rng = random.Random(seed)
    box = lambda: (x := rng.uniform(-50, 600), y := rng.uniform(-20, 800), x + rng.uniform(0, width), y + rng.uniform(0, 25))
    rects = [(p, *box()) for p in range(n_pages) for _ in range(n_rects)]
    caps = [(p, p * 10 + k, rng.choice(["figure", "table"]), *box(), 800.0) for p in range(n_pages) for k in range(3)]
    return caps, rects


def frames(spark, caps, rects):
    return spark.createDataFrame(caps, CAPTION), spark.createDataFrame(rects, f"page_id long, {BOX}")


@pytest.mark.parametrize("dense", [0, 30, 10**6])
def test_growing(spark, dense):
    """In rows, in rounds, or both: the same regions."""
    caps, rects = pages(3, 6, 20)
    more = pages(4, 3, 60)
    caps, rects = caps + [(p + 50, c + 500, *r) for p, c, *r in more[0]], rects + [(p + 50, *r) for p, *r in more[1]]
    got = {r.caption_id: tuple(r)[1:] for r in G.region_grow(*frames(spark, caps, rects), dense=dense).collect()}
    assert got == {c[1]: grown(c[2], c[3:7], [r[1:] for r in rects if r[0] == c[0]], 800.0) for c in caps}
    assert any(v[0] is not None for v in got.values()) and any(v[0] is None for v in got.values())


def test_page_of_fifty_thousand(spark):
    rng = random.Random(5)
    rects = [(1, x := rng.uniform(0, 600), y := rng.uniform(500, 650), x + rng.uniform(0, 3), y + rng.uniform(0, 5)) for _ in range(50_000)]
    caps = [(1, 1, "figure", 100.0, 640.0, 300.0, 650.0, 800.0), (1, 2, "table", 250.0, 500.0, 280.0, 510.0, 800.0), (1, 3, "figure", 0.0, 400.0, 600.0, 410.0, 800.0)]
    c, r = frames(spark, caps, rects)
    got = {x.caption_id: tuple(x)[1:] for x in G.region_grow(c, r).collect()}
    assert got == {x[1]: grown(x[2], x[3:7], [y[1:] for y in rects], 800.0) for x in caps}
    near = {x.caption_id: x.gap for x in G.nearest_rect(c, r).collect()}
    for x in caps:
        gaps = [(x[4] - y[4] if x[2] == "figure" else y[2] - x[6]) for y in rects if min(x[5], y[3]) - max(x[3], y[1]) > 0]
        gaps = [g for g in gaps if -2 <= g <= 400]
        assert near.get(x[1]) == (min(gaps) if gaps else None)


def test_smallest_font(spark):
    """Boxes over many cells, beyond the page, upside down, and without a span."""
    rng = random.Random(2)
    spans = [(1, x := rng.uniform(-200, 9000), y := rng.uniform(-200, 900), x + 5.0, y + 5.0, float(rng.randint(0, 30))) for _ in range(2000)]
    boxes = [(1, 1, -500.0, -500.0, 9999.0, 999.0), (1, 2, 100.0, 100.0, 400.0, 300.0), (1, 3, 4000.0, 0.0, 8000.0, 500.0), (1, 4, 400.0, 300.0, 100.0, 100.0), (2, 5, 0.0, 0.0, 900.0, 900.0), (1, 6, None, 0.0, 5.0, 5.0)]
    got = {r.box_id: r.min_font for r in G.min_font(spark.createDataFrame(boxes, f"page_id long, box_id long, {BOX}"), spark.createDataFrame(spans, f"page_id long, {BOX}, size double")).collect()}
    want = {}
    for p, b, x0, y0, x1, y1 in boxes:
        inside = [s[5] for s in spans if s[0] == p and x0 is not None and x0 <= (s[1] + s[3]) / 2 <= x1 and y0 <= (s[2] + s[4]) / 2 <= y1 and s[5] > 0]
        want[b] = min(inside) if inside else None
    assert got == want and got[1] == 1.0


def test_region_around_the_nearest(spark):
    """Three panels above a caption join; a block far above does not; what misses the caption in x does not either."""
    caps = [(1, 1, "figure", 100.0, 500.0, 300.0, 510.0, 1000.0), (1, 2, "table", 100.0, 800.0, 300.0, 810.0, 1000.0), (2, 3, "figure", 0.0, 900.0, 50.0, 910.0, 1000.0)]
    rects = [(1, 110.0, 400.0, 200.0, 490.0), (1, 190.0, 350.0, 290.0, 450.0), (1, 120.0, 300.0, 180.0, 320.0), (1, 100.0, 100.0, 300.0, 150.0), (1, 400.0, 400.0, 500.0, 490.0), (2, 0.0, 100.0, 50.0, 300.0)]
    got = {r.caption_id: tuple(r)[1:] for r in G.associated_region(*frames(spark, caps, rects)).collect()}
    assert got == {1: (110, 300, 290, 490)}


def norm(s):
    return re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()


def accepted(a, b):
    a, b = norm(a), norm(b)
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    return a == b or len(short) >= 15 and long.startswith(short) or difflib.SequenceMatcher(None, a, b).ratio() >= 0.95


def near(spark, queries, records):
    q, r = (spark.createDataFrame(list(enumerate(x)), f"{n}_id long, title string") for x, n in ((queries, "query"), (records, "record")))
    return B.near_titles(q, r), q, r


def test_literal_titles(spark):
    queries = ["Attention Is All You Need", "attention is all you need!", "Is Attention All You Need", "Deep Residual Learning", "Learn", None, "", "???"]
    records = ["Attention Is All You Need", "Deep residual learning: for images", "Learning", "", None]
    got = {(r.query_id, r.record_id) for r in near(spark, queries, records)[0].collect()}
    assert got == {(0, 0), (1, 0), (3, 1)}


def test_lower_thresholds_are_refused(spark):
    titles = spark.createDataFrame([(1, "abcdefg")], "query_id long, title string")
    with pytest.raises(ValueError):
        B.near_titles(titles, titles.withColumnRenamed("query_id", "record_id"), B.LEAST_RATIO - 0.01)
    for n in range(1, 2_000):
        edits = int((1 - B.LEAST_RATIO) * (1 + (2 - B.LEAST_RATIO) / B.LEAST_RATIO) * n + 1e-9)
        assert edits == 0 or B.GRAM * edits < n - B.GRAM + 1


def test_all_pairs(spark):
    """The joins find exactly the pairs that a comparison of all finds, each once."""
    rng = random.Random(7)
    syllables = "ta ri no ke lo aa su mi".split()
    base = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 7))) for _ in range(70)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 14))):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        return "".join(t) + rng.choice(["", "", " again", ": more of it"])

    queries, records = [changed(rng.choice(base)) for _ in range(150)], [changed(t) for t in base for _ in range(2)] + ["a" * 60, "a" * 61, "ab" * 30]
    queries += ["a" * 60, "aa" + "ab" * 30]
    pairs, q, r = near(spark, queries, records)
    got = [(x.query_id, x.record_id) for x in pairs.collect()]
    want = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(records) if accepted(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 80
    best = {x.query_id: x.record_id for x in B.resolve_titles(q, r).collect()}
    assert best.keys() == set(range(len(queries))) and {i for i, j in best.items() if j is not None} == {i for i, _ in want}
    assert all(j is None or (i, j) in want for i, j in best.items())


def test_rects_of_a_page_meet_captions_once(spark):
    """On pages of few rects nothing is copied to cells: one exchange of captions and one of rects; both ways give the same."""
    from folioguard.plans import catalogue as C

    sf = "/root/testdata/sf0.001"
    caps, rects = C.caps(spark, sf), C.rects(spark, sf)
    for f in (G.nearest_rect, G.associated_region):
        few = f(caps, rects)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "explode" not in plan and plan.count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, f(caps, rects, dense=4).collect())) == sorted(map(tuple, f(caps, rects, dense=0).collect()))
