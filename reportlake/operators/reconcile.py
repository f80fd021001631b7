"""Word-loss reconciliation between a source and its output: where lost words belong."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import let, strip_marker

_WORD = re.compile(r"\S+")
#: Words quoted before and behind a gap.
CONTEXT = 3


def _plain(words: list[str]) -> list[str]:
    return [re.sub(r"[^a-z0-9.]+", "", w.lower()).strip(".") for w in words]


def gaps(source: str, output: str) -> list[tuple[int, str, str, str]]:
    """(place in the output, lost words, words before, words behind) of each lost run."""
    a, b = _WORD.findall(source), _WORD.findall(output)
    steps = difflib.SequenceMatcher(None, _plain(a), _plain(b), autojunk=False).get_opcodes()
    return [(j1, " ".join(a[i1:i2]), " ".join(a[max(0, i1 - CONTEXT) : i1]), " ".join(a[i2 : i2 + CONTEXT])) for tag, i1, i2, j1, _ in steps if tag in ("delete", "replace")]


def restored(source: str, output: str) -> tuple[str, int]:
    """The output with all lost runs put back in their places, and how many."""
    found, spans, out, last = gaps(source, output), [m.end() for m in _WORD.finditer(output)], [], 0
    for at, lost, _, _ in found:
        end = spans[at - 1] if at else 0
        out += [output[last:end], ("" if not end else " ") + lost + (" " if not end and output else "")]
        last = end
    return "".join([*out, output[last:]]), len(found)


def word_diff(source: str, output: str) -> str:
    """One line of words with ``[-lost-]`` and ``{+added+}`` runs."""
    a, b = _WORD.findall(source), _WORD.findall(output)
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out += a[i1:i2]
            continue
        out += [f"[-{' '.join(a[i1:i2])}-]"] * (i2 > i1) + [f"{{+{' '.join(b[j1:j2])}+}}"] * (j2 > j1)
    return " ".join(out)


def plan(pairs: DataFrame, key: str, source: str, output: str) -> DataFrame:
    """``key, place, lost, before, behind``: one row per lost run; texts are aligned word by
    word inside a task, row for row.  Null texts count as empty ones."""
    return _rows(pairs, key, source, output, lambda s, o: gaps(s, o), "place int, lost string, before string, behind string")


def auto_restored(pairs: DataFrame, key: str, source: str, output: str) -> DataFrame:
    """``key, text, runs, diff``: the output with lost runs put back."""
    return _rows(pairs, key, source, output, lambda s, o: [(*restored(s, o), word_diff(s, o))], "text string, runs int, diff string")


def _rows(pairs: DataFrame, key: str, source: str, output: str, make, schema: str) -> DataFrame:
    kind = pairs.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, s, o in zip(b["k"], b["s"], b["o"], strict=True) for r in make(s, o)], columns=names)

    src = pairs.select(F.col(key).alias("k"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in ((source, "s"), (output, "o"))))
    return src.mapInPandas(run, f"`{key}` {kind}, {schema}")


def audit_summary(source: Column, output: Column, letterhead: Column | None = None) -> Column:
    """STRUCT ``missing, added, passed`` in tokens, list markers of the source and the words
    of the letterhead left out; what the letterhead holds more than the output counts nothing."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:\.[0-9]+)?|[a-z0-9]+)"), 1)
    text = lambda c: F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), strip_marker), "\n")
    a, b = tokens(text(source)), tokens(F.coalesce(output, F.lit("")))
    head = tokens(F.coalesce(letterhead, F.lit(""))) if letterhead is not None else F.array().cast("array<string>")
    # the k-th time a token stands in a bag is an element of its own, so differences of bags are differences of sets

    def numbered(xs: Column) -> Column:
        return let(F.array_sort(xs), lambda bag: F.transform(bag, lambda x, i: F.concat_ws(" ", x, (i - F.array_position(bag, x)).cast("string"))))

    own = F.transform(F.array_except(numbered(b), numbered(head)), lambda x: F.split_part(x, F.lit(" "), F.lit(1))) if letterhead is not None else b
    def compared(two: Column) -> Column:
        lost, more = F.size(F.array_except(two["a"], two["b"])), F.size(F.array_except(two["b"], two["a"]))
        return F.struct(lost.alias("missing"), more.alias("added"), (lost == 0).alias("passed"))

    return let(F.struct(numbered(a).alias("a"), numbered(own).alias("b")), compared)
