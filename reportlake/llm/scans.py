"""Text of scanned pages repaired into continuous paragraphs.

Misread characters are undone by folding: every glyph is written as the strokes it
is confused with (``h`` and ``u`` as ``ll``, ``d`` as ``cl``, ``m`` as ``rn`` and so
on), so that a word and its misreadings have one fold.  Skip-gram vectors are learned
on all pages: of each word that may be misread or right, the words around it with their
counts, weighted by association.  Rare words are linked to frequent words of the same
fold that stand in like contexts, and every occurrence is corrected to the candidate
that its own neighbours speak for.  Words split in two and words broken over a line end
are found by the fold of both parts.  Furniture lines are those whose fold keeps to the
edges of pages.

The vectors are counts, not a network: they are summed by Spark, hold for rare words as
well as for frequent ones, and nothing of the vocabulary comes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.session import cut, small

# Glyphs and what recognition makes of them, one stroke group for both sides.
STROKES = (("h", "ll"), ("u", "ll"), ("d", "cl"), ("m", "rn"), ("w", "vv"))
GLYPHS = ("i1|05@eqt", "lllosacgf")
MARKS = "-­¬‐‑"

#: A fold is furniture if it keeps this part of its lines to the edges of pages.
EDGE_SHARE = 0.8
EDGE_LINES = 3
MIN_EDGE = 3
MIN_EDGE_SCAN = 2
#: How often a word must occur for each time of its misreading, by length.
RATIO_LONG, RATIO_SHORT = 2.5, 8.0
LONG_WORD = 6
MIN_TARGET = 3
#: Below this ratio, words must also stand in like contexts.
SURE_RATIO = 40.0
MIN_FIT = 0.12
#: Times that two words may stand together beyond chance; more count alike, so that a
#: single rare neighbour does not outweigh all others.
MOST_LIFT = 20.0
#: Words to each side that make a context.
SPAN = 3
#: Confidence of a page (percent) that leaves the ratio as it is; pages read worse need
#: less, pages read better need more, within these bounds.
USUAL_CONFIDENCE = 80.0
CONFIDENCE_BOUNDS = (0.75, 1.25)


def fold(text: Column) -> Column:
    """A word in strokes: equal for words that recognition confuses."""
    out = F.lower(text)
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return F.translate(out, *GLYPHS)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}@]+)"), 1)


def page_lines(pages: DataFrame) -> DataFrame:
    """``page_id, scan_id, page_no, confidence, line_no, line, edge`` of every line;
    confidence is null where the engine gives none (null, 0 or below).

    A repeated page_id counts once; null or empty texts and null ids give no lines.
    Lines are told apart by line feed; a carriage return before it is dropped."""
    one = (
        pages.where("page_id is not null and text is not null and text <> ''")
        .groupBy("page_id")
        .agg(F.min(F.struct("scan_id", "page_no", "text", "confidence")).alias("p"))
        .select("page_id", "p.scan_id", "p.page_no", F.when(F.col("p.confidence") > 0, F.col("p.confidence")).alias("confidence"), F.split(F.replace("p.text", F.lit("\r\n"), F.lit("\n")), "\n").alias("lines"))
    )
    full = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    edges = F.concat(F.slice("full", 1, EDGE_LINES), F.slice("full", F.greatest(F.size("full") - EDGE_LINES + 1, F.lit(1)), EDGE_LINES))
    return (
        one.withColumn("full", full)
        .withColumn("edges", edges)
        .select("page_id", "scan_id", "page_no", "confidence", "edges", F.posexplode("lines").alias("line_no", "line"))
        .select("page_id", "scan_id", "page_no", "confidence", "line_no", "line", F.array_contains("edges", F.col("line_no")).alias("edge"))
    )


_PAGE_NUMBER = (
    r"(?i)^[\s\[(|—–-]*(?:p(?:a[gq][ec]|[gq])?\.?\s*)?[0-9lIoO]{1,4}(?:\s*(?:[o0][ft]|/)\s*[0-9lIoO]{1,4})?[\s\])|—–-]*$"
)
_ROMAN = r"^[\s\[(—–-]*(?i:[ivxl1]{1,6})[\s\])—–-]*$"


def classified(lines: DataFrame) -> DataFrame:
    """Adds ``kind``: ``running``, ``pageno``, ``blank`` or ``text``.

    Shapes of edge lines are counted over all pages and within their scan; numbers are
    left out of a shape, so that a header with the page number keeps its shape."""
    plain = F.lower(F.regexp_replace(F.trim("line"), r"(?<![\p{L}0-9@])(?=[\p{L}0-9]*[0-9])[0-9lIOSoB]+(?![\p{L}0-9@])", "#"))
    shape = F.regexp_replace(F.regexp_replace(plain, r"^[\s#/.,\[\]()-]+|[\s#/.,\[\]()-]+$", ""), r"\s+", " ")
    known = lines.withColumn("shape", F.when(F.trim("line") != "", fold(shape)))
    counted = known.where("length(shape) >= 4").groupBy("shape", "scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("at_edge"), F.countDistinct("page_id").alias("pages"),
        F.count_if(F.col("line").rlike(r"^\s*[\p{Lu}\d]")).alias("headed"),
    )
    counted = cut(counted)
    overall = counted.groupBy("shape").agg(F.sum("n").alias("all_n"), F.sum("at_edge").alias("all_edge"))
    kept = counted.join(overall, "shape").where(
        (F.col("all_edge") >= EDGE_SHARE * F.col("all_n"))
        & ((F.col("all_edge") >= MIN_EDGE) | ((F.col("pages") >= MIN_EDGE_SCAN) & (F.col("at_edge") == F.col("n")) & (F.col("headed") == F.col("n"))))
    ).select("shape", "scan_id", F.lit(True).alias("kept"))
    marked = known.join(kept, (known.shape == kept.shape) & known.scan_id.eqNullSafe(kept.scan_id), "left").select(known["*"], "kept")
    bare = F.col("line").rlike(_PAGE_NUMBER) | F.col("line").rlike(_ROMAN)
    kind = (
        F.when(F.trim("line") == "", "blank")
        .when(F.col("edge") & bare & ~F.col("line").rlike(r"\.\s*$"), "pageno")
        .when(F.col("edge") & F.col("kept"), "running")
        .otherwise("text")
    )
    return marked.withColumn("kind", kind).drop("shape", "kept")


def in_order(lines: DataFrame) -> DataFrame:
    """Running text with the line before and after it in the scan: ``broken`` says that
    the last word goes on with a mark, ``ahead`` and ``behind`` hold the neighbours.

    Neighbours on the same page come from a window over the page, those across pages
    from a join on the page number, so a scan of any length needs no single task."""
    text = lines.where("kind = 'text'")
    here = Window.partitionBy("page_id").orderBy("line_no")
    near = text.withColumns({"next_here": F.lead("line").over(here), "last_here": F.lag("line").over(here)})
    firsts = near.where("last_here is null").select("scan_id", (F.col("page_no") - 1).alias("page_no"), F.col("line").alias("next_page"))
    lasts = near.where("next_here is null").select("scan_id", (F.col("page_no") + 1).alias("page_no"), F.col("line").alias("last_page"))
    one = lambda df, c: df.groupBy("scan_id", "page_no").agg(F.min(c).alias(c))
    inner = near.where("next_here is not null and last_here is not null").withColumns(
        {"next_page": F.lit(None).cast("string"), "last_page": F.lit(None).cast("string")}
    )
    outer = (
        near.where("next_here is null or last_here is null")
        .join(one(firsts, "next_page"), ["scan_id", "page_no"], "left")
        .join(one(lasts, "last_page"), ["scan_id", "page_no"], "left")
    )
    ends = lambda c: c.rlike(rf"\p{{L}}@?\s?[{MARKS}]\s*$") | c.rlike(rf"@[{MARKS}]\s*$")
    every = inner.unionByName(outer).withColumns(
        {"ahead": F.coalesce("next_here", "next_page"), "behind": F.coalesce("last_here", "last_page")}
    )
    return every.select(
        "page_id", "scan_id", "page_no", "confidence", "line_no", "line", "ahead",
        (ends(F.col("line")) & F.col("ahead").isNotNull()).alias("broken"),
        F.coalesce(ends(F.col("behind")), F.lit(False)).alias("carried"),
    )


def tokens(ordered: DataFrame) -> DataFrame:
    """Adds ``toks``: the words that stand whole in their line."""
    w = words(F.col("line"))
    whole = F.slice(w, F.when(F.col("carried"), 2).otherwise(1), F.greatest(F.size(w) - F.col("carried").cast("int") - F.col("broken").cast("int"), F.lit(0)))
    return ordered.withColumn("toks", whole)


# a number with a letter that recognition takes for a digit; levels of the spine (L5-S1) are none
_BAD_NUMBER = (
    r"(?<![\p{L}\p{N}@-])(?:[0-9]+[.,/]?[lIOSo]+[0-9]*(?![\p{L}\p{N}])|[lIOo]+[.,/]?[0-9]+(?![\p{L}\p{N}])|S[.,/][0-9]"
    r"|S[0-9]+(?=\s*(?:mm|cm|ml|x |weeks|months|minutes|years|%)))"
)


_BAD_NUMBER_PY = _BAD_NUMBER.replace(r"[\p{L}\p{N}@-]", r"[\w@-]").replace(r"[\p{L}\p{N}]", r"[^\W_]")


def contexts(lined: DataFrame, words: DataFrame) -> DataFrame:
    """``page_id, line_no, pos, word, near``: each occurrence of the given words with the
    words up to ``SPAN`` before (``-word``) and behind it (``+word``) in its line."""
    placed = lined.where("size(toks) > 1").select("page_id", "line_no", "toks", F.posexplode("toks").alias("pos", "word"))
    before = F.transform(F.slice("toks", F.greatest(F.col("pos") - SPAN + 1, F.lit(1)), F.least("pos", F.lit(SPAN))), lambda w: F.concat(F.lit("-"), w))
    behind = F.transform(F.slice("toks", F.col("pos") + 2, F.lit(SPAN)), lambda w: F.concat(F.lit("+"), w))
    around = placed.select("page_id", "line_no", "pos", "word", F.array_distinct(F.concat(before, behind)).alias("near"))
    return around.join(small(cut(words.select("word").distinct())), "word", "left_semi").withColumn("near", F.explode("near"))


def skip_gram(lined: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, near, a``: sparse skip-gram vectors of the given words, the association of
    each with the words around it: log(1 + lift), where lift is n * all / (n of word * n
    of near), ``MOST_LIFT`` at most.

    Counted over all pages; pairs are summed on the map side before they are shuffled."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).scalar()
    pairs = contexts(lined, words).groupBy("word", "near").agg(F.count(F.lit(1)).alias("c"))
    known = counts.select("word", F.col("n").alias("wn"))
    about = counts.select(F.col("word").alias("bare"), F.col("n").alias("nn"))
    return (
        pairs.withColumn("bare", F.expr("substring(near, 2)")).join(known, "word").join(about, "bare")
        .select("word", "near", F.log1p(F.least(F.lit(MOST_LIFT), F.col("c") * total / (F.col("wn") * F.col("nn")))).alias("a"))
    )


def candidates(counts: DataFrame) -> DataFrame:
    """``word, right, edits, ratio, odd, pure``: rare words with the more frequent words of
    their fold.

    ``odd`` says that the word has a sign that no word has (``@``, or a digit between
    letters).  ``counts``: word, n, confidence."""
    every = counts.withColumns({"f": fold(F.col("word")), "pure": F.col("word").rlike(r"^\p{L}+$")})
    right = every.where((F.col("pure")) & (F.col("n") >= MIN_TARGET)).select("f", F.col("word").alias("right"), F.col("n").alias("m"))
    rare = every.where(F.col("word").rlike(r"[\p{L}@]")).select("f", "word", "n", "pure", "confidence")
    odd = ~F.col("pure") & F.col("word").rlike(r"@|^\p{L}+[0-9]\p{L}*$|^[0-9]\p{L}{2,}$|\p{L}[0-9]\p{L}")
    few = F.length("word") <= 3
    edits, ratio = F.levenshtein("word", "right"), F.col("m") / F.col("n")
    return rare.join(right, "f").where("word <> right and m > n").select(
        "word", "right", "m", edits.alias("edits"), ratio.alias("ratio"), "pure", (odd & (~few | ((edits <= 1) & (ratio >= RATIO_SHORT)))).alias("odd"), "confidence"
    )


def misreadings(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``word, right, edits, m, fit``: the candidates that hold.

    ``fit`` is the part of the rare word's associations that the right word has, too.  A
    word without odd signs needs a ratio of counts (less on pages of low confidence, more
    on those of high confidence) and, unless that is overwhelming, a ``fit``."""
    own = vectors.groupBy("word").agg(F.sum("a").alias("all"))
    va, vb = vectors.select("word", "near", "a"), vectors.select(F.col("word").alias("right"), "near")
    shared = pairs.select("word", "right").join(va, "word").join(vb, ["right", "near"]).groupBy("word", "right").agg(F.sum("a").alias("shared"))
    fitted = pairs.join(shared, ["word", "right"], "left").join(own, "word", "left").withColumn("fit", F.coalesce(F.col("shared") / F.col("all"), F.lit(0.0)))
    trust = F.greatest(F.lit(CONFIDENCE_BOUNDS[0]), F.least(F.lit(CONFIDENCE_BOUNDS[1]), F.coalesce(F.col("confidence") / USUAL_CONFIDENCE, F.lit(1.0))))
    needed = F.when(F.length("right") >= LONG_WORD, RATIO_LONG).otherwise(RATIO_SHORT) * trust
    plain = F.col("pure") & (F.col("ratio") >= needed) & ((F.col("ratio") >= SURE_RATIO) | (F.col("fit") >= MIN_FIT))
    return fitted.where(F.col("odd") | plain).select("word", "right", "edits", "m", "fit")


def corrected(lined: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """``page_id, line_no, wrong, right``: every occurrence of a misread word with the
    candidate it is corrected to.

    Fewest edits come first; among those, the word whose vector holds most of the
    neighbours of this very occurrence, then the most frequent one."""
    least = links.groupBy("word").agg(F.min("edits").alias("edits"))
    closest = small(cut(links.join(least, ["word", "edits"]).select("word", "right", "m")))
    where_ = lined.where("size(toks) > 0").select("page_id", "line_no", F.posexplode("toks").alias("pos", "word")).join(closest, "word")
    speaks = (
        contexts(lined, closest).join(closest.select("word", "right"), "word").join(vectors.select(F.col("word").alias("right"), "near", "a"), ["right", "near"])
        .groupBy("page_id", "line_no", "pos", "right").agg(F.sum("a").alias("said"))
    )
    judged = where_.join(speaks, ["page_id", "line_no", "pos", "right"], "left")
    best = F.max_by("right", F.struct(F.round(F.coalesce("said", F.lit(0.0)), 6), "m", "right"))
    return judged.groupBy("page_id", "line_no", "pos", F.col("word").alias("wrong")).agg(best.alias("right")).select("page_id", "line_no", "wrong", "right").distinct()


def _by_fold(counts: DataFrame, links: DataFrame) -> DataFrame:
    """``f, right, m``: the most frequent right word of each fold."""
    ok = counts.join(links.select("word").distinct(), "word", "left_anti").where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= MIN_TARGET))
    return ok.withColumn("f", fold(F.col("word"))).groupBy("f").agg(F.max(F.struct("n", "word")).alias("b")).select("f", F.col("b.word").alias("right"), F.col("b.n").alias("m"))


def splits(lined: DataFrame, best: DataFrame) -> DataFrame:
    """``a, b, right``: neighbouring words that are one word split in two."""
    pair = lined.where("size(toks) > 1").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size("toks") - 2), lambda i: F.struct(F.get("toks", i).alias("a"), F.get("toks", i + 1).alias("b")))).alias("p")
    ).select("p.a", "p.b")
    counted = pair.where(F.col("a").rlike(r"^\p{L}[\p{L}@0-9]+$") & F.col("b").rlike(r"^[\p{L}@][\p{L}@0-9]+$")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.withColumn("f", fold(F.concat("a", "b"))).join(best, "f")
        .where((F.length("right") >= 5) & (F.col("m") >= 5) & (F.col("m") > 3 * F.col("n")))
        .select("a", "b", "right")
    )


def repairs(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines with kind, links of misread words, repairs, joins over a line end).

    repairs: ``page_id, line_no, wrong, right``; joins: ``page_id, line_no, first,
    second, right, soft`` where soft says that the parts are one word without hyphen."""
    lines = cut(classified(page_lines(pages)))
    lined = cut(tokens(in_order(lines)))
    counts = cut(lined.select("confidence", F.explode("toks").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence")))
    pairs = cut(candidates(counts))
    named = pairs.select("word").unionByName(pairs.select(F.col("right").alias("word")))
    vectors = cut(skip_gram(lined, named, counts))
    links = cut(misreadings(pairs, vectors))
    best = cut(_by_fold(counts, links))
    single = corrected(lined, links, vectors)
    cuts = splits(lined, best)
    twos = lined.where("size(toks) > 1").select(
        "page_id", "line_no",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("toks") - 2), lambda i: F.struct(F.get("toks", i).alias("a"), F.get("toks", i + 1).alias("b")))).alias("p"),
    ).select("page_id", "line_no", "p.a", "p.b")
    double = twos.join(cuts, ["a", "b"]).select("page_id", "line_no", F.concat_ws(" ", "a", "b").alias("wrong"), "right")
    # compounds that keep their hyphen inside a line
    compounds = (
        lined.select(F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"(?=(?<![\p{L}\p{N}@])([\p{L}\p{N}@]+-[\p{L}\p{N}@]+))[\p{L}\p{N}@]+"), 1)).alias("c"))
        .where("c <> ''").groupBy(fold(F.col("c")).alias("fc")).agg(F.count(F.lit(1)).alias("k"))
    )
    ends = lined.where("broken").select(
        "page_id", "line_no", F.element_at(words(F.col("line")), -1).alias("first"), F.get(words(F.col("ahead")), F.lit(0)).alias("second")
    ).where("first is not null and second is not null")
    joined = (
        ends.withColumns({"f": fold(F.concat("first", "second")), "fc": fold(F.concat_ws("-", "first", "second"))})
        .join(best, "f", "left").join(compounds, "fc", "left")
    )
    digits = F.col("first").rlike("[0-9]") | F.col("second").rlike("[0-9]")
    alone = lambda c, w: counts.select(F.col("word").alias(c), F.col("n").alias(w))
    joined = joined.join(alone("first", "n1"), "first", "left").join(alone("second", "n2"), "second", "left")
    j, k = F.coalesce("m", F.lit(0)), F.coalesce("k", F.lit(0))
    two_words = (F.coalesce("n1", F.lit(0)) >= 20) & (F.coalesce("n2", F.lit(0)) >= 20)
    soft = F.when((j == 0) & (k == 0), ~digits & ~two_words).otherwise((j > 0) & (j >= k))
    joins = joined.select(
        "page_id", "line_no", "first", "second", F.when(j > 0, F.col("right")).otherwise(F.concat("first", "second")).alias("right"), soft.alias("soft")
    )
    return lines, links, single.unionByName(double), cut(joins)


def _line_after(lines: DataFrame, marked: DataFrame) -> DataFrame:
    """``page_id, line_no`` of the lines of running text after those of ``marked`` (same columns)."""
    after = Window.partitionBy("page_id").orderBy("line_no")
    text = lines.where("kind = 'text'").withColumns({"next_no": F.lead("line_no").over(after), "last_no": F.lag("line_no").over(after)})
    same_page = marked.join(text.where("next_no is not null").select("page_id", "line_no", "next_no"), ["page_id", "line_no"]).select(
        "page_id", F.col("next_no").alias("line_no")
    )
    heads = text.where("last_no is null").select("scan_id", "page_no", F.col("page_id").alias("to_page"), F.col("line_no").alias("to_line"))
    lasts = text.where("next_no is null").select("page_id", "line_no", "scan_id", (F.col("page_no") + 1).alias("page_no"))
    next_page = marked.join(lasts, ["page_id", "line_no"]).join(heads, ["scan_id", "page_no"]).select(
        F.col("to_page").alias("page_id"), F.col("to_line").alias("line_no")
    )
    return same_page.unionByName(next_page)


def found(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, kind`` of furniture lines, broken and misread lines.

    Pages without text give no rows; a repeated page_id counts once."""
    lines, links, fixes, joins = repairs(pages)
    furniture = lines.where("kind in ('running', 'pageno')").select("page_id", "line_no", "kind")
    soft, kept = joins.where("soft"), joins.where("not soft")
    hyphens = soft.select("page_id", "line_no", F.lit("hyphen").alias("kind"))
    # a misread part of a broken word lies in the line of that part
    wrong = soft.where(F.concat("first", "second") != F.col("right"))
    at = lambda df: df.select("page_id", "line_no")
    known = lambda c: links.select(F.col("word").alias(c)).distinct()
    first_bad = at(wrong.where("not startswith(right, first)")).unionByName(at(kept.join(known("first"), "first", "left_semi")))
    second_bad = at(wrong.where("not endswith(right, second)")).unionByName(at(kept.join(known("second"), "second", "left_semi")))
    numbers = at(lines.where((F.col("kind") == "text") & F.col("line").rlike(_BAD_NUMBER)))
    bad = at(fixes).unionByName(numbers).unionByName(first_bad).unionByName(_line_after(lines, second_bad)).distinct()
    return (
        furniture.unionByName(hyphens).unionByName(bad.withColumn("kind", F.lit("misread"))).distinct()
        .select("page_id", F.col("line_no").cast("int"), "kind")
    )


_NUMBER_GLYPHS = str.maketrans("lIOoS", "11005")


def number_repaired(line: str) -> str:
    """Letters that stand for digits inside a number, as digits."""
    return re.sub(_BAD_NUMBER_PY, lambda m: m.group().translate(_NUMBER_GLYPHS), line)


def _in_case(wrong: str, right: str) -> str:
    return right.upper() if wrong.isupper() and len(wrong) > 1 else right.capitalize() if wrong[:1].isupper() else right


def paragraphs(pages: DataFrame) -> DataFrame:
    """``scan_id, paragraph, text``: the repaired text of each scan.

    Words are corrected where they stand, broken words closed up, furniture dropped,
    and lines run together up to the next blank line or indented one; a paragraph goes
    on over the end of a page unless its last line ends a sentence and the next page
    begins with a capital after a blank line.  Scans without text give no rows."""
    lines, _, fixes, joins = repairs(pages)
    per_line = fixes.groupBy("page_id", "line_no").agg(F.collect_set(F.struct("wrong", "right")).alias("fixes"))
    marked = (
        lines.where("kind in ('text', 'blank')")
        .join(per_line, ["page_id", "line_no"], "left")
        .join(joins.select("page_id", "line_no", F.struct("soft", "first", "second", "right").alias("join")), ["page_id", "line_no"], "left")
        .select("page_id", "scan_id", "page_no", F.struct("line_no", "line", "fixes", "join").alias("x"))
        .groupBy("page_id", "scan_id", "page_no").agg(F.array_sort(F.collect_list("x"), lambda a, b: a.line_no - b.line_no).alias("xs"))
    )

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for scan, no, xs in zip(b["scan_id"], b["page_no"], b["xs"], strict=True):
                text, starts, n, seen, drop = "", True, 0, False, ""
                for x in xs:
                    line = x["line"].strip()
                    if not line or x["line"][:3] == "   ":
                        if text:
                            out.append((scan, no, n, text, seen and not starts))
                            n, text, starts = n + 1, "", True
                        if not line:
                            seen = True
                            continue
                    for f in x["fixes"] if x["fixes"] is not None else ():
                        pattern = r"(?<![\w@])" + r"\s+".join(map(re.escape, f["wrong"].split())) + r"(?![\w@])"
                        line = re.sub(pattern, lambda m, r=f["right"]: _in_case(m.group(), r), line, flags=re.I)
                    line = number_repaired(line)
                    j = x["join"]
                    if drop and line.lower().startswith(drop):
                        line = line[len(drop) :]
                    drop = ""
                    if j is not None:
                        line = re.sub(rf"\s?[{MARKS}]$", "" if j["soft"] else "-", line)
                        if j["soft"] and j["first"] + j["second"] != j["right"] and line.lower().endswith(j["first"]):
                            whole = line[len(line) - len(j["first"]) :]
                            line, drop = line[: -len(whole)] + _in_case(whole, j["right"]), j["second"]
                        line += "\x00"
                    if not text:
                        starts = n > 0 or seen
                    text = text[:-1] + line if text.endswith("\x00") else f"{text} {line}".strip()
                    seen = True
                if text:
                    out.append((scan, no, n, text, False))
            yield pd.DataFrame(out, columns=["scan_id", "page_no", "n", "text", "fresh"])

    parts = cut(marked.mapInPandas(mend, "scan_id string, page_no int, n int, text string, fresh boolean"))
    # number the paragraphs: one row per page in the window, not one per line
    by_page = Window.partitionBy("scan_id").orderBy("page_no")
    edge = parts.groupBy("scan_id", "page_no").agg(
        F.count(F.lit(1)).alias("k"), F.min_by("text", "n").alias("head"), F.max_by("text", "n").alias("tail")
    ).withColumn("before", F.lag("tail").over(by_page))
    goes_on = F.col("before").isNotNull() & ~(F.col("before").rlike(r"[.?!:]$") & F.col("head").rlike(r"^\p{Lu}"))
    placed = edge.withColumn("on", goes_on.cast("int")).select(
        "scan_id", "page_no", "on", (F.sum(F.col("k") - F.col("on")).over(by_page) - F.col("k")).alias("at")
    )
    numbered = parts.join(placed, ["scan_id", "page_no"]).select("scan_id", (F.col("at") + F.col("n")).alias("paragraph"), F.struct("page_no", "text").alias("t"))
    joined = numbered.groupBy("scan_id", "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t.text), " ").alias("text"))
    return joined.select("scan_id", "paragraph", F.replace(F.replace("text", F.lit("\u0000 "), F.lit("")), F.lit("\u0000"), F.lit("")).alias("text"))
