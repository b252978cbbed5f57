"""Queries of decks as HTML and of PPTX files, with the SQL for the same rows."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from folioguard.operators import deck as D
from folioguard.operators import layouts as L
from folioguard.operators import parity as P
from folioguard.plans.catalogue import _query, _sql
from folioguard.sources import pptx as X
from folioguard.sources.readers import table

# One slide for each part, eleven to a deck, in all layouts; {t} is a text with marks, emphasis and a formula.
LAYOUT_SLIDES = """SELECT CAST(floor(p_partkey / 11) AS BIGINT) AS deck_id, row_number() OVER (PARTITION BY floor(p_partkey / 11) ORDER BY p_partkey) AS slide, p_partkey AS p, p_partkey % 11 AS k, p_size AS n, p_name AS name FROM part"""
SPEC = """to_json(named_struct(
  'layout', element_at(array('paper-title', 'section', 'outline-agenda', 'assertion-evidence', 'equation', 'results-table', 'two-column', 'critique-concerns', 'discussion-questions', 'bullets', 'references'), CAST(k + 1 AS INT)),
  'title', t, 'action_title', CASE WHEN p % 2 = 0 THEN 'Act' END, 'eyebrow', CASE WHEN n % 3 = 0 THEN 'A & B' END, 'source_ref', CASE WHEN n % 5 = 0 THEN 'p. <3>' END, 'speaker_notes', CASE WHEN n % 4 = 0 THEN 'say "it"' END,
  'authors', CASE WHEN k = 0 AND n % 2 = 0 THEN parse_json('["Ann","Bo <x>"]') WHEN k = 0 THEN parse_json('"Ann"') END, 'affiliation', CASE WHEN n % 2 = 0 THEN 'Lab' END, 'venue', CASE WHEN n % 3 = 0 THEN 'V' END,
  'num', CASE WHEN k = 1 AND n % 2 = 0 THEN CAST(n AS STRING) END, 'items', CASE WHEN k = 2 THEN array(t, 'b', 'c') END, 'current', n % 4,
  'figure', CASE WHEN k = 3 OR k = 6 AND n % 3 = 0 THEN named_struct('src', concat('f', n % 5, '.png'), 'caption', CASE WHEN n % 7 > 0 THEN 'Cap <' END, 'cite', CASE WHEN n % 2 = 0 THEN 'Fig. 1' END, 'alt', CASE WHEN k = 6 THEN 'A' END, 'fit', CASE WHEN k = 6 THEN 'cover' END, 'hero', k = 3 AND n % 3 = 0) END,
  'annotation', CASE WHEN k = 3 AND n % 3 > 0 THEN 'note $$y$$' END, 'equations', CASE WHEN k = 4 THEN array(named_struct('latex', 'a<b', 'num', CAST(n AS STRING), 'numbered', true), named_struct('latex', 'c', 'num', CAST(NULL AS STRING), 'numbered', false)) END,
  'note', CASE WHEN k = 4 THEN t END, 'table', CASE WHEN k = 5 AND n % 10 = 0 THEN parse_json('{"rows":[]}') WHEN k = 5 THEN parse_json('{"columns":["A",{"label":"B","unit":"%"}],"rows":[["x",{"v":"1","bold":true}]]}') END,
  'points', CASE WHEN k = 6 AND n % 2 = 0 OR k = 9 THEN array(CAST(t AS VARIANT), parse_json('"p"')) WHEN k = 7 THEN array(to_variant_object(named_struct('head', t, 'body', 'b'))) END, 'text', CASE WHEN k = 6 THEN t END, 'points2', CASE WHEN k = 6 THEN array('x', t) END,
  'questions', CASE WHEN k = 8 THEN array(t, 'why?') END, 'entries', CASE WHEN k = 10 THEN array_repeat('E', CAST(n % 6 + 1 AS INT)) END))"""


def layout_decks(spark, sf):
    """Decks and the sizes of their pictures."""
    slides = _sql(spark, sf, LAYOUT_SLIDES, "part").withColumn("t", F.expr("concat(name, ' <b> & ==k|up== $x_', n, '$')")).select("deck_id", "slide", "n", F.expr(SPEC).alias("spec"))
    decks = slides.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide", "spec"))).alias("x"))
    meta = F.expr("""concat('{"meta":{"title":"Deck <', deck_id, '>"', CASE WHEN deck_id % 2 = 0 THEN ',"theme":"conference","language":"zh"' ELSE ',"theme":"own"' END, '},"slides":[')""")
    decks = decks.select("deck_id", F.concat(meta, F.array_join("x.spec", ","), F.lit("]}")).alias("spec"))
    sizes = slides.select("deck_id", F.concat(F.lit("f"), F.col("n") % 5, F.lit(".png")).alias("src"), F.struct((100 * (F.col("n") % 5 + 1)).alias("width"), F.lit(100).alias("height")).alias("size"))
    return decks, sizes.distinct()


LAYOUT_SQL = f"""WITH s AS ({LAYOUT_SLIDES}),
m AS (SELECT *, concat(name, ' &lt;b&gt; &amp; <span class="key">up</span> <span class="math inline">\\(x_', n, '\\)</span>') AS t,
  CASE WHEN n % 2 = 0 THEN ' <span class="cite">[Fig. 1]</span>' ELSE '' END AS c, n % 7 > 0 AS captioned, n % 5 = 0 AS sourced FROM s),
u AS (SELECT *, concat('<div class="s-title-bar">', CASE WHEN n % 3 = 0 THEN '<div class="s-eyebrow">A &amp; B</div>' ELSE '' END, '<h2 class="s-action-title">', CASE WHEN p % 2 = 0 THEN 'Act' ELSE t END, '</h2></div>') AS bar,
  CASE WHEN sourced THEN '<div class="s-source"><span class="cite">p. &lt;3&gt;</span></div>' ELSE '' END AS source,
  concat('<figure class="s-figure"><img src="f', n % 5, '.png" alt="', CASE WHEN k = 6 THEN 'A' WHEN captioned AND n % 3 > 0 THEN 'Cap &lt;' ELSE 'figure' END, '"', CASE WHEN n % 5 >= 2 THEN concat(' class="wide" style="--fig-ar:', n % 5 + 1, '.00"') ELSE '' END,
    ' style="object-fit:', CASE WHEN k = 6 THEN 'cover' ELSE 'contain' END, '">', CASE WHEN captioned AND (k = 6 OR n % 3 > 0) THEN concat('<figcaption>Cap &lt;', c, '</figcaption>') ELSE '' END, '</figure>') AS fig FROM m),
i AS (SELECT *, CASE k
  WHEN 0 THEN concat('paper-title"><div class="slide-inner s-paper-title"><h1>', t, '</h1><div class="authors">', CASE WHEN n % 2 = 0 THEN 'Ann, Bo &lt;x&gt;' ELSE 'Ann' END, '</div>', CASE WHEN n % 2 = 0 THEN '<div class="affil">Lab</div>' ELSE '' END, CASE WHEN n % 3 = 0 THEN '<div class="venue">V</div>' ELSE '' END)
  WHEN 1 THEN concat('section"><div class="slide-inner s-section">', CASE WHEN n % 2 = 0 THEN concat('<div class="num">', n, '</div>') ELSE '' END, '<h2>', t, '</h2>')
  WHEN 2 THEN concat('outline-agenda"><div class="slide-inner s-agenda">', bar, '<div class="s-body"><ol><li class="', CASE WHEN n % 4 = 0 THEN 'cur' ELSE '' END, '">', t, '</li><li class="', CASE WHEN n % 4 = 1 THEN 'cur' ELSE '' END, '">b</li><li class="', CASE WHEN n % 4 = 2 THEN 'cur' ELSE '' END, '">c</li></ol></div>')
  WHEN 3 THEN concat('assertion-evidence"><div class="slide-inner s-ae', CASE WHEN n % 3 = 0 THEN ' s-ae--hero' ELSE '' END, '">', bar, '<div class="s-body">', fig, CASE WHEN n % 3 > 0 THEN '<div class="s-annotation">note <span class="math display">\\[y\\]</span></div>' ELSE '' END, '</div>',
    CASE WHEN n % 3 = 0 AND captioned THEN concat('<div class="s-source">Cap &lt;', c, CASE WHEN sourced THEN ' · <span class="cite">p. &lt;3&gt;</span>' ELSE '' END, '</div>') ELSE source END)
  WHEN 4 THEN concat('equation"><div class="slide-inner s-equation">', bar, '<div class="s-body"><div class="eq"><span class="math display">\\[a&lt;b\\]</span><span class="eq-num">(', n, ')</span></div><div class="eq"><span class="math display">\\[c\\]</span></div><div class="note">', t, '</div></div>', source)
  WHEN 5 THEN CASE WHEN n % 10 > 0 THEN concat('results-table"><div class="slide-inner s-results">', bar, '<div class="s-body"><table class="results roomy"><thead><tr><th>A</th><th>B<span class="u">%</span></th></tr></thead><tbody><tr><td>x</td><td><strong>1</strong></td></tr></tbody></table></div>', source) END
  WHEN 6 THEN concat('two-column"><div class="slide-inner s-two-col">', bar, '<div class="s-body"><div class="cols"><div class="col-text">', CASE WHEN n % 2 = 0 THEN concat('<ul><li>', t, '</li><li>p</li></ul>') ELSE t END, '</div><div class="col-fig">', CASE WHEN n % 3 = 0 THEN fig ELSE concat('<ul><li>x</li><li>', t, '</li></ul>') END, '</div></div></div>', source)
  WHEN 7 THEN concat('critique-concerns"><div class="slide-inner s-critique">', bar, '<div class="s-body"><div class="pt"><div class="head">', t, '</div><div class="body">b</div></div></div>', source)
  WHEN 8 THEN concat('discussion-questions"><div class="slide-inner s-discussion">', bar, '<div class="s-body"><ul><li>', t, '</li><li>why?</li></ul></div>')
  WHEN 9 THEN concat('bullets"><div class="slide-inner s-bullets">', bar, '<div class="s-body"><ul><li>', t, '</li><li>p</li></ul></div>', source)
  ELSE concat('references"><div class="slide-inner s-references">', bar, '<div class="s-body"><ol', CASE WHEN n % 6 < 3 THEN ' class="single"' ELSE '' END, '>', repeat('<li>E</li>', CAST(n % 6 + 1 AS INTEGER)), '</ol></div>') END AS inner_html FROM u),
h AS (SELECT deck_id, slide, '<section data-layout="' || inner_html || '</div>' || CASE WHEN n % 4 = 0 THEN '<aside class="notes">say &quot;it&quot;</aside>' ELSE '' END || '</section>' AS html FROM i)
"""


@_query(LAYOUT_SQL + "SELECT * FROM h")
def slide_html(spark, sf):
    decks, pictures = layout_decks(spark, sf)
    return L.slide_html(L.slides_to_render(decks), pictures)


@_query(LAYOUT_SQL + """SELECT deck_id, CASE WHEN count(html) = count(*) THEN concat('<!doctype html>
<html lang="', CASE WHEN deck_id % 2 = 0 THEN 'zh' ELSE 'en' END, '">
<head>
<meta charset="utf-8">
<meta name="viewport" content="width=device-width, initial-scale=1">
<title>Deck ', deck_id, '</title>
<link rel="stylesheet" href="assets/katex.min.css">
<link rel="stylesheet" href="assets/tokens.css">
<link rel="stylesheet" href="assets/viewport-base.css">
<link rel="stylesheet" href="assets/base-theme.css">
<link rel="stylesheet" href="assets/', CASE WHEN deck_id % 2 = 0 THEN 'conference' ELSE 'journal-club' END, '.css">
<link rel="stylesheet" href="assets/print.css">
</head>
<body>
<div class="reveal"><div class="slides">
', string_agg(html, chr(10) ORDER BY slide), '
</div></div>

</body>
</html>') END AS html FROM h GROUP BY deck_id""")
def deck_page(spark, sf):
    decks, pictures = layout_decks(spark, sf)
    return L.deck_html(decks, printed=True, pictures=pictures)


# A deck for each conversation, a slide for each turn. What the file lacks of the specification follows from the slide's number.
TURNS = "SELECT conv_id AS deck_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS slide, role, coalesce(text, '') AS text FROM conversations"


def pptx_bytes(slides: list[dict]) -> bytes:
    """A PPTX of no more parts than a reader needs; slide k lies in the file of slide n + 1 - k, so file names are in no order.

    A slide: title (a break after its first word), text, notes, rows (of a table), picture, film, grouped (a text in a group), each may be missing.
    """
    a, p, r = ("http://schemas.openxmlformats.org/" + x for x in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships"))
    spaces, links = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"', '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    run = lambda t: f"<a:r><a:t>{escape(t)}</a:t></a:r>"
    body = lambda t, tag="p": f"<{tag}:txBody><a:bodyPr/>" + "".join(f"<a:p>{run(x[: len(x) // 2])}{run(x[len(x) // 2 :])}</a:p>" for x in t.split("\n")) + f"</{tag}:txBody>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8"?>\n{text}')
        put("_rels/.rels", f'{links}<Relationship Id="rId1" Type="{r}/officeDocument" Target="ppt/presentation.xml"/></Relationships>')
        ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
        put("ppt/presentation.xml", f"<p:presentation {spaces}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        put("ppt/_rels/presentation.xml.rels", links + "".join(f'<Relationship Id="rId{k}" Type="{r}/slide" Target="slides/slide{len(slides) + 1 - k}.xml"/>' for k in range(1, len(slides) + 1)) + "</Relationships>")
        for k, s in enumerate(slides, 1):
            n, shapes = len(slides) + 1 - k, ""
            if s.get("title") is not None:
                first, *rest = s["title"].split(" ")
                shapes += f"<p:sp><p:nvSpPr/><p:txBody><a:p>{run(first)}<a:br/>{run(' '.join(rest))}</a:p></p:txBody></p:sp>"
            if s.get("grouped"):
                shapes += f"<p:grpSp><p:sp>{body(s['grouped'])}</p:sp></p:grpSp>"
            if s.get("rows"):
                rows = "".join("<a:tr>" + "".join(f"<a:tc>{body(c, 'a')}</a:tc>" for c in row) + "</a:tr>" for row in s["rows"])
                shapes += f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
            if s.get("text") is not None:
                shapes += f"<p:sp><p:nvSpPr/>{body(s['text'])}</p:sp>"
            if s.get("picture"):
                shapes += "<p:pic><p:nvPicPr><p:nvPr/></p:nvPicPr></p:pic>"
            if s.get("film"):
                shapes += '<p:pic><p:nvPicPr><p:nvPr><a:videoFile r:link="rId9"/></p:nvPr></p:nvPicPr></p:pic>'
            put(f"ppt/slides/slide{n}.xml", f"<p:sld {spaces}><p:cSld><p:spTree><p:nvGrpSpPr/>{shapes}</p:spTree></p:cSld></p:sld>")
            if s.get("notes") is not None:
                put(f"ppt/slides/_rels/slide{n}.xml.rels", f'{links}<Relationship Id="rId1" Type="{r}/notesSlide" Target="../notesSlides/notesSlide{n}.xml"/></Relationships>')
                holder = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>{body(t)}</p:sp>'
                put(f"ppt/notesSlides/notesSlide{n}.xml", f"<p:notes {spaces}><p:cSld><p:spTree>{holder('sldNum', '7')}{holder('body', s['notes'])}</p:spTree></p:cSld></p:notes>")
    return out.getvalue()


def _made(decks: pd.DataFrame) -> pd.DataFrame:
    """The PPTX of one deck, out of its slides."""
    slides = []
    for s in decks.sort_values("slide").itertuples():
        k = int(s.slide)
        slides.append({
            "title": f"Turn {k}", "text": None if k % 3 == 0 else s.text, "notes": f"say {s.role}" if k % 2 == 0 and k % 8 > 0 else None, "picture": s.role == "user" and k % 5 > 0, "film": k % 5 == 0,
            "rows": [[s.role, str(k)], ["9", "9"]] if s.role == "assistant" and k % 4 > 0 else None, "grouped": "unseen",
        })
    content = b"broken" if int(decks.deck_id.iloc[0]) % 10 == 9 else pptx_bytes(slides)
    return pd.DataFrame({"deck_id": [int(decks.deck_id.iloc[0])], "content": [content]})


def pptx_decks(spark, sf):
    return _sql(spark, sf, TURNS, "conversations").groupBy("deck_id").applyInPandas(_made, "deck_id long, content binary")


@_query(f"""SELECT deck_id, slide, concat_ws(chr(32) || chr(10) || chr(32), 'Turn' || chr(11) || slide, CASE WHEN tabled THEN concat_ws(chr(32) || chr(10) || chr(32), role, slide, '9', '9') END, CASE WHEN slide % 3 > 0 THEN text END) AS text,
  CASE WHEN slide % 2 = 0 AND slide % 8 > 0 THEN 'say ' || role ELSE '' END AS notes, CASE WHEN tabled THEN concat(role, '|', slide, '|9|9') ELSE '' END AS cells, role = 'user' AND slide % 5 > 0 AS has_picture, tabled AS has_table
FROM (SELECT *, role = 'assistant' AND slide % 4 > 0 AS tabled FROM ({TURNS})) WHERE deck_id % 10 <> 9""")
def pptx_slides(spark, sf):
    return X.built_slides(X.pptx_shapes(pptx_decks(spark, sf))).withColumn("cells", F.array_join("cells", "|"))


@_query("SELECT DISTINCT conv_id AS deck_id FROM conversations WHERE conv_id % 10 = 9")
def pptx_unreadable(spark, sf):
    return X.unreadable(X.pptx_shapes(pptx_decks(spark, sf)))


@_query(f"""WITH t AS ({TURNS}), r AS (SELECT * FROM t WHERE deck_id % 10 <> 9)
SELECT deck_id, slide, 'missing-text' AS kind, 'points[0]' AS field FROM r WHERE role <> 'assistant' AND slide % 3 = 0 AND trim(text) <> ''
UNION ALL SELECT deck_id, slide, 'missing-text', concat('table.cell[', unnest(CASE WHEN slide % 4 = 0 THEN [0, 1, 2, 3] WHEN slide = 9 THEN [] ELSE [3] END), ']') FROM r WHERE role = 'assistant'
UNION ALL SELECT deck_id, slide, 'missing-table', '' FROM r WHERE role = 'assistant' AND slide % 4 = 0
UNION ALL SELECT deck_id, slide, 'missing-figure', '' FROM r WHERE role = 'user' AND slide % 5 = 0
UNION ALL SELECT deck_id, slide, 'missing-notes', '' FROM r WHERE slide % 8 = 0
UNION ALL SELECT deck_id, 0, 'slide-count', concat(count(*), '/0') FROM t WHERE deck_id % 10 = 9 GROUP BY deck_id""")
def pptx_parity(spark, sf):
    """A deck's specification against its PPTX: an assistant's turn asks for a table with three cells of 9, others for their text."""
    spec = F.expr("""to_json(named_struct('layout', CASE WHEN role = 'assistant' THEN 'results-table' ELSE 'bullets' END, 'title', concat('Turn  ', slide), 'points', array(text), 'speaker_notes', CASE WHEN slide % 2 = 0 THEN concat('Say ', role) END,
      'figure', CASE WHEN role = 'user' THEN named_struct('src', 'f.png') END, 'table', CASE WHEN role = 'assistant' THEN named_struct('rows', array(array(CAST(slide AS STRING), '9'), array('9', '9'))) END))""")
    decks = _sql(spark, sf, TURNS, "conversations").groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide", spec.alias("spec")))).alias("x"))
    slides = D.slides_of(decks.select("deck_id", F.concat(F.lit('{"slides":['), F.array_join("x.spec", ","), F.lit("]}")).alias("spec")))
    return P.parity_findings(slides, X.built_slides(X.pptx_shapes(pptx_decks(spark, sf))))
