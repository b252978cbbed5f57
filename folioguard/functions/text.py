"""Text functions. All are Catalyst expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and tables that results depend on.
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
NAME = r"[A-Z][A-Za-zÀ-ɏ'`-]+"
FLAG = r"\[(?:MISSING|UNVERIFIED|REDRAWN|GENERATED)(?![A-Za-z0-9_])[^\]]*\]"
EMPHASIS = r"==(?:[kpw]\|)?([\s\S]+?)=="
#: Narrower than the Unicode property of pictographs, which Java 17 lacks.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
CJK_MARKS = r"[\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
LATIN_WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"
NUMBER = r"\d+(?:\.\d+)?"
CITED = r"\[([0-9][0-9,\-\s]*)\]"
HEADING = r"^\s*#{1,6}\s+(.+?)\s*$"
MATH = r"\$\$([\s\S]+?)\$\$|\$([^$\n]+?)\$"
DATA_LAYOUT = 'data-layout="([^"]+)"'
IMAGE_SOURCE = '<img[^>]+src="([^"]+)"'
KATEX = r'<span class="katex[\s\S]*?</span></span>'
SHOWN_MATH = r"\$[^$\n]{1,80}\$"
HTML_PLACEHOLDERS = ("presenter", "presenters", "date", "name", "author", "authors", "venue", "affiliation", "institute", "email", "todo", "tbd", "placeholder", "your name", "主讲人", "日期", "姓名", "单位", "汇报人")


def map_superscripts(s: Column) -> Column:
    """Superscripts as digits; a text of ASCII has none and stays as it is."""
    return F.when(F.length(s) == F.octet_length(s), s).otherwise(F.translate(s, *SUPERSCRIPTS))


def number_tokens(s: Column) -> Column:
    """Runs of digits with an optional fraction, superscripts read as digits."""
    return F.regexp_extract_all(map_superscripts(F.coalesce(s, F.lit(""))), F.lit(NUMBER), 0)


def rejoin_decimals(s: Column) -> Column:
    """'34.' and '1' apart by white space become '34.1'."""
    return F.regexp_replace(s, r"(\d+\.)\s+(\d+)", "$1$2")


def flags(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(FLAG), 0)


def strip_emphasis(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), EMPHASIS, "$1")


def render_emphasis(escaped: Column) -> Column:
    """Marks of an escaped text as spans of class key, pos, warn, or metric for a bare mark."""
    marked = F.regexp_replace(F.coalesce(escaped, F.lit("")), r"==(?:([kpw])\|)?([\s\S]+?)==", "<span class=\"\x00$1\">$2</span>")
    for role, name in (("k", "key"), ("p", "pos"), ("w", "warn"), ("", "metric")):
        marked = F.replace(marked, F.lit(f'class="\x00{role}"'), F.lit(f'class="{name}"'))
    return marked


def math_segments(s: Column) -> Column:
    """array<struct<kind, text>> of prose, inline ($..$, one line) and display ($$..$$) parts in order; empty prose is left out."""
    cut = F.regexp_replace(F.coalesce(s, F.lit("")), MATH, "\x00d$1\x01$2\x00")
    parts = F.split(cut, "\x00")

    def segment(p: Column, i: Column) -> Column:
        display, inline = F.substring_index(F.substring(p, 2, 1 << 30), "\x01", 1), F.substring_index(p, "\x01", -1)
        math = F.when(display != "", F.struct(F.lit("display").alias("kind"), display.alias("text"))).otherwise(F.struct(F.lit("inline").alias("kind"), inline.alias("text")))
        return F.when(i % 2 == 1, math).when(p != "", F.struct(F.lit("prose").alias("kind"), p.alias("text")))

    return F.array_compact(F.transform(parts, segment))


def emphasis_roles(s: Column) -> Column:
    """Distinct roles: key, pos, warn, or metric for a bare mark, sorted."""
    marks = F.regexp_extract_all(s, F.lit(r"==(?:([kpw])\|)?[\s\S]+?=="), 1)
    role = lambda m: F.when(m == "k", "key").when(m == "p", "pos").when(m == "w", "warn").otherwise("metric")
    return F.array_sort(F.array_distinct(F.transform(marks, role)))


def strip_inline_math(s: Column) -> Column:
    """The slide variant: $$..$$ and one-line $..$ lose their marks, then emphasis does."""
    return strip_emphasis(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"\$\$([\s\S]+?)\$\$", "$1"), r"\$([^$\n]+?)\$", "$1"))


def strip_math(s: Column) -> Column:
    """The parity variant: $..$ may span lines, $$ is not special."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"\$([^$]+)\$", "$1"), r"==(?:[kpw]\|)?(.+?)==", "$1")


def normalised(s: Column) -> Column:
    """Without marks of math and emphasis, white space as single blanks, lower case. One search tells whether there is anything to replace."""
    whole = F.when(F.rlike(s, F.lit(r"\$|==|\s\s|[\t\n\x0b\f\r]")), F.regexp_replace(strip_math(s), r"\s+", " ")).otherwise(F.coalesce(s, F.lit("")))
    return F.lower(F.trim(whole))


def contains_whole(haystack: Column, needle: Column) -> Column:
    """``needle`` occurs outside of ASCII letters and digits; an empty one always does.

    A search for the text alone, and a look at what stands beside its first place, decide nearly always. The pattern, which has to be
    compiled for each row, is for a first place inside a word.
    """
    at = F.call_function("locate", needle, haystack)
    beside = F.concat(F.when(at > 1, F.substring(haystack, at - 1, F.lit(1))).otherwise(F.lit("")), F.substring(haystack, at + F.length(needle), F.lit(1)))
    pattern = F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![0-9a-z])"))
    plain = F.when(needle == "", True).when(at == 0, False).when(~F.rlike(beside, F.lit("[0-9a-z]")), True)
    return plain.otherwise(F.regexp_like(haystack, pattern))


def emojis(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(EMOJI), 0))


def cjk_chars(s: Column) -> Column:
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(CJK)).cast("long")


def latin_words(s: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), CJK, " "), CJK_MARKS, " ")
    return F.regexp_count(plain, F.lit(LATIN_WORD)).cast("long")


def minutes(s: Column, wpm: float = 130, cpm: float = 240) -> Column:
    return latin_words(s) / F.lit(wpm) + cjk_chars(s) / F.lit(cpm)


def clock(m: Column) -> Column:
    """Minutes as m:ss, rounded as a whole, so that 60 seconds never show."""
    s = F.round(m * 60).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def clock_faithful(m: Column) -> Column:
    """Minutes as m:ss with the seconds rounded alone, which may show 60."""
    return F.format_string("%d:%02d", F.floor(m), F.floor((m - F.floor(m)) * 60 + 0.5).cast("long"))


def excerpt(line: Column, most: int = 180) -> Column:
    t = F.trim(line)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def citation_numbers(line: Column) -> Column:
    """Numbers cited by [..]: lists and hyphen ranges of up to 51; a bracket with a bad part counts for nothing.

    Numbers of over 18 digits are no BIGINT; they are left out, and the others of their bracket stay.
    """
    brackets = F.regexp_extract_all(line, F.lit(CITED), 1)

    def part(p: Column) -> Column:
        p = F.trim(p)
        a, b = (F.regexp_extract(p, r"^(\d{1,18})\s*-\s*(\d{1,18})$", k).try_cast("long") for k in (1, 2))
        one = F.when(F.regexp_like(p, F.lit(r"^\d{1,18}$")), p.try_cast("long"))
        bad = F.array(F.lit(-1).cast("long"))
        fine = a.isNotNull() & b.isNotNull() & (a > 0) & (a <= b) & (b <= a + 50)
        return (
            F.when(F.regexp_like(p, F.lit(r"^\d+\s*-\s*\d+$")), F.when(fine, F.sequence(F.when(fine, a).otherwise(1), F.when(fine, b).otherwise(1))).otherwise(bad))
            .when(F.regexp_like(p, F.lit(r"^\d+$")), F.when(one.isNull(), F.array().cast("array<long>")).when(one > 0, F.array(one)).otherwise(bad))
            .otherwise(F.array().cast("array<long>"))
        )

    parsed = F.transform(brackets, lambda b: F.flatten(F.transform(F.split(b, ","), part)))
    # Most lines have one bracket with one number.
    alone = F.regexp_extract(line, r"\A[^\[]*\[((?=[0-9]{1,18}\])0*[1-9][0-9]*)\][^\[]*\z", 1)
    return F.when(alone != "", F.array(alone.try_cast("long"))).otherwise(F.flatten(F.filter(parsed, lambda x: ~F.array_contains(x, F.lit(-1).cast("long")))))


def author_citations(line: Column) -> Column:
    """array<struct<surname, n>> of 'Name et al. [n]' and 'Name and Other [n]'."""
    p = F.lit(rf"({NAME})\s+(?:et\s+al\.?|and\s+(?:colleagues|co-?workers|{NAME}))\s*\[(\d+)\]")
    return F.transform(F.arrays_zip(F.regexp_extract_all(line, p, 1).alias("a"), F.regexp_extract_all(line, p, 2).alias("b")), lambda x: F.struct(F.lower(x["a"]).alias("surname"), x["b"].try_cast("long").alias("n")))


def author_tokens(entry: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.substring(entry, 1, 80), F.lit(NAME), 0), F.lower)


def heading(line: Column) -> Column:
    """Text of a Markdown heading without closing marks; null if the line is none."""
    text = F.when(F.contains(line, F.lit("#")), F.regexp_extract(line, HEADING, 1))
    return F.when(text != "", F.trim(F.regexp_replace(text, r"^[：: .]+|[：: .]+$", "")))


def normalised_title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9]+", " "))


def roman(s: Column) -> Column:
    """Value of a roman numeral, null for other texts."""
    value = lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv)), c)
    v = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), value)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    folded = F.aggregate(F.reverse(v), zero, lambda a, x: F.struct((a["total"] + F.when(x < a["last"], -x).otherwise(x)).alias("total"), F.greatest(x, a["last"]).alias("last")))
    return F.when(F.regexp_like(s, F.lit("^[IVXLCDM]+$")), folded["total"])


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.coalesce(s, F.lit(""))


def crop_key(src: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(src, "/"), -1), r"(?i)\.[a-z0-9]+$", "")


def source_stem(arg: Column) -> Column:
    """Folder name for a source: its file name without extension, other than word characters as underscores."""
    base = F.element_at(F.split(F.coalesce(arg, F.lit("")), "/"), -1)
    stem = slug(F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1"))
    return F.when(stem == "", "source").otherwise(stem)


def source_kind(arg: Column, is_file: Column) -> Column:
    """struct<kind, arxiv_id>: file, arxiv (an id, or a URL that holds one), or unknown."""
    own = F.regexp_extract(F.trim(arg), r"^(\d{4}\.\d{4,5})(?:v\d+)?$", 1)
    url = F.regexp_extract(arg, r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    found = F.coalesce(F.nullif(own, F.lit("")), F.nullif(url, F.lit("")))
    file = F.coalesce(is_file, F.lit(False))
    return F.struct(F.when(file, "file").when(found.isNotNull(), "arxiv").otherwise("unknown").alias("kind"), F.when(~file, found).alias("arxiv_id"))


def with_extension(path: Column, mime: Column) -> Column:
    """The path with the extension of a picture's type instead of its own."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", ""), extension_for_mime(mime))


def slug(stem: Column) -> Column:
    return F.regexp_replace(stem, r"(?U)[^\w]+", "_")


def extension_for_mime(mime: Column) -> Column:
    return F.when(mime.isin("image/jpeg", "image/jpg"), ".jpg").when(mime == "image/webp", ".webp").otherwise(".png")


def px_to_inches(px: Column) -> Column:
    return F.round(px / 1920 * 13.333, 3)


def image_format(content: Column) -> Column:
    """png, jpg or webp by the first bytes; unknown counts as png."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpg").when((head == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp").otherwise("png")


def png_size(content: Column) -> Column:
    """struct<width, height> of a PNG, else null."""
    n = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(n(17).alias("width"), n(21).alias("height")))


def probed_size(content: Column) -> Column:
    """``png_size`` of files whose first chunk is the header and that have an area, else null."""
    size = png_size(content)
    return F.when((F.hex(F.substring(content, 13, 4)) == "49484452") & (size["width"] > 0) & (size["height"] > 0), size)


def arxiv_id(text: Column, stamp_only: bool = False) -> Column:
    """The id of the margin stamp (followed by a bracket), else any id unless only stamps count."""
    stamp = F.nullif(F.regexp_extract(text, r"(?i)arXiv:(\d{4}\.\d{4,5})(?:v\d+)?\s*\[", 1), F.lit(""))
    return stamp if stamp_only else F.coalesce(stamp, F.nullif(F.regexp_extract(text, r"(?i)arXiv:(\d{4}\.\d{4,5})", 1), F.lit("")))


# Static checks on built HTML.
def data_layouts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(DATA_LAYOUT), 1)


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(IMAGE_SOURCE), 1)


def katex_errors(html: Column) -> Column:
    return F.regexp_count(html, F.lit("katex-error")).cast("long")


def unrendered_math(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(html, KATEX, ""), "<[^>]+>", " ")
    return F.regexp_extract_all(plain, F.lit(SHOWN_MATH), 0)


def html_placeholders(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?i)&lt;\s*(?:{'|'.join(HTML_PLACEHOLDERS)})\s*&gt;"), 0)
    return F.transform(found, lambda m: F.concat(F.lit("<"), F.trim(F.regexp_replace(m, "&lt;|&gt;", "")), F.lit(">")))
