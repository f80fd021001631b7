"""Confusables skeleton: texts that look the same get the same skeleton.

A text is decomposed, each character is replaced by the prototype of its look-alike
class, and the result is decomposed again.  The look-alike table is the published
Unicode confusables data of all characters, as the ICU library among Spark's jars holds
it; presentation forms beyond it (ligatures, no-break variants) follow from the Unicode
decomposition tags, and characters without a look of their own are dropped.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.session import cut

# Prototypes of the data that are themselves drawn like a lower-case letter.
LOWER_CASE = {"ĸ": "k", "ᴛ": "t"}
# Characters that are not drawn, beside those of category Cf.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0)
#: Decompositions of these kinds leave the look of a character as it is.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Categories whose characters may have a look-alike.
SEEN = "LMNPSZ"


@lru_cache(1)
def _characters() -> list[str]:
    """All characters with a look, without the large blocks that have no look-alikes
    (unified ideographs, Hangul syllables)."""
    blocks = ("CJK UNIFIED", "HANGUL SYLLABLE", "TANGUT", "EGYPTIAN", "ANATOLIAN", "CUNEIFORM")
    return [c for c in map(chr, range(0x20, 0x32000)) if unicodedata.category(c)[0] in SEEN and not unicodedata.name(c, "").startswith(blocks)]


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Character -> prototype for every character that has another one than itself."""
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    chars = _characters()
    looks = checker.getSkeleton("\n".join(chars)).split("\n")
    final = str.maketrans(LOWER_CASE)
    table = {c: p.translate(final) for c, p in zip(chars, looks, strict=True)}
    return {c: p for c, p in table.items() if unicodedata.normalize("NFD", c) != p}


class _Table(dict):
    """Code point -> prototype, worked out on first use of a character."""

    def __init__(self, known: dict[str, str]) -> None:
        super().__init__({code: None for code in INVISIBLE})
        self.known = known

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        tag, _, parts = unicodedata.decomposition(ch).partition(" ")
        if unicodedata.category(ch) == "Cf":
            out = None
        elif unicodedata.category(ch) == "Zs":
            out = " "
        elif tag in SAME_LOOK:
            out = "".join(chr(int(x, 16)) for x in parts.split()).translate(self)
        else:
            out = self.known.get(ch, ch)
        self[code] = out
        return out


def make_skeleton(known: dict[str, str]):
    """A function text -> skeleton with its own character cache."""
    table = _Table(known)
    ends, trailing = re.compile("\r\n?| | |\x85"), re.compile(r"[ \t]+$", re.M)
    decompose = lambda t: t if t.isascii() else unicodedata.normalize("NFD", t)

    def skeleton(text: str) -> str:
        text = decompose(decompose(text).translate(table))
        return trailing.sub("", ends.sub("\n", text)).strip("\n")

    return skeleton


def with_skeleton(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, form``: each text in its one consistent form.

    Null stays null, empty and blank texts become the empty form; whole texts are
    treated, of any length.  Repeated rows stay repeated."""
    table = docs.sparkSession.sparkContext.broadcast(prototypes(docs.sparkSession))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skeleton = make_skeleton(table.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "form": b["text"].map(lambda t: None if t is None else skeleton(t))})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(forms, "doc_id bigint, form string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, raw, skel``: 16-byte digests of every non-blank text and of its skeleton,
    written once."""
    table = docs.sparkSession.sparkContext.broadcast(prototypes(docs.sparkSession))

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skeleton = make_skeleton(table.value)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            yield pd.DataFrame({"doc": b["doc_id"], "raw": b["text"].map(digest), "skel": b["text"].map(lambda t: digest(skeleton(t)))})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S")
    )
    return cut(src.mapInPandas(both, "doc bigint, raw binary, skel binary").distinct())


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, members, spellings``: one row per document with a non-blank
    text: the smallest id of its class, how many documents it holds and how many
    different texts.  The class table with which copies need no pairs."""
    keyed = digests(docs, id_col, text_col)
    classes = keyed.groupBy("skel", "raw").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).groupBy("skel").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("spellings")
    )
    return keyed.join(classes, "skel").select(F.col("doc").alias("doc_id"), "class_id", "members", "spellings")


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a, doc_b``: documents whose non-blank texts look the same though their
    characters differ.

    Only 16-byte digests of skeleton and text are shuffled.  Classes in which all
    texts are equal from the start (however many copies) are dropped before the join,
    by the smallest and largest text digest of the class, so the join holds only
    classes with a difference; adaptive execution splits a class that fills a
    partition.  Repeated document ids count once."""
    keyed = digests(docs, id_col, text_col)
    mixed = keyed.groupBy("skel").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("skel")
    members = keyed.join(mixed, "skel", "left_semi")
    a = members.select("skel", F.col("raw").alias("raw_a"), F.col("doc").alias("doc_a"))
    b = members.select("skel", F.col("raw").alias("raw_b"), F.col("doc").alias("doc_b"))
    return a.join(b, "skel").where("doc_a < doc_b and raw_a <> raw_b").select("doc_a", "doc_b").distinct()
