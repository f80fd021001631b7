"""Personal identifiers in free text by bootstrapped contextual extraction.

One pass over the texts emits candidate instances (runs of uncommon words, long
numbers, mail addresses, house-to-town spans) with the words to their left.  Spark
then scores the bipartite graph of context patterns and instances: seeds score the
patterns they occur in, good patterns score further instances, and so on for a few
rounds.  Instances of numbers, mail addresses and addresses are their shapes, instances
of names their spelling.  Only some shapes are seeds; the others become identifiers by
the patterns they share with them.  What a confident pattern or shape marks is an
identifier.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.operators.units import NUMBER_WORDS
from reportlake.session import cut

#: A word is common if it stands in this part of all texts; a text of w words on
#: average makes at most w / COMMON_SHARE words common, which bounds the broadcast.
COMMON_SHARE = 0.004
ROUNDS = 3
#: Patterns need this purity and support to mark instances.
MIN_PURITY = 0.80
MIN_NAME_SHARE = 0.45
MIN_SUPPORT = 2
#: Part of a shape's occurrences that confident patterns must cover.
MIN_COVER = 0.40
#: Given names and short forms at most (a list of common knowledge).
MAX_LIST = 50_000
#: Digits from which a number can identify a person; shorter ones are numbers of things.
MIN_DIGITS = 6
#: Rows of scores that are broadcast at most.
MAX_BROADCAST_ROWS = 100_000

# Titles and degrees, which are not part of a name.
TITLES = "mr mrs ms miss mister missus master shri smt dr prof doctor professor".split()
DEGREES = "mbbs md ms dm mch dnb phd frcr".split()

_POSTAL = r"(?:\d{6}|\d{3} \d{3}|[A-Z]{1,2}\d{1,2} \d[A-Z]{2})(?![\w-])"
_HOUSE = r"(?:(?:Flat|Plot|House|Door|H\.|P\.\s?O\.)\s?(?:No\.|Box)?\s*)?"
# house to postal code, read in the stretch that ends with the code
_ADDRESS = rf"(?<![\w/.-]){_HOUSE}\d[\w/-]*,? +[A-Z][A-Za-z0-9 ,.'-]{{2,}}?{_POSTAL}$"
_STREET = r"\b[A-Z]\w+(?:strasse|straße|gasse|weg|platz)\s+\d+\w?,\s*\d{5}\s+[A-Z][\w-]+"
_MAIL = (
    r"(?<![\w.+-])[\w.+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:(?:\.| \. )[\w-]+)+"
    r"|\b\w[\w+-]*(?: dot \w+)* at \w+(?: dot \w+)+"
)
_NUMBER = (
    r"(?<![\w@.])(?:[A-Z]{1,3}[-/]?\d\d[\dA-Z]*(?:[-/][\dA-Z]+)*"
    r"|(?:\+\d{1,3}(?=[ -]\d)|\(?\d{3,14}\)?)(?:[ .-]\(?\d{2,6}\)?){0,4}(?:[-/][A-Z]\b)?)(?![\w@])"
)
_SPAN = {
    "mail": re.compile(_MAIL),
    "num": re.compile(_NUMBER),
}
_CODE, _TO_CODE, _STREETS = re.compile(_POSTAL), re.compile(_ADDRESS), re.compile(_STREET)
_HAS_POSTAL = re.compile(r"\d{3}[\d ]\d\d|\d \d[A-Z]|\d, \d{5}")
_NON_WORD = {c: " " for c in range(128) if not (chr(c).isalnum() or chr(c) in "'-_")}
_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?")

CANDIDATES = (
    "place string, key string, type string, value string, short string, shape string, p2 string, p1 string, seed string"
)

# Number formats that are public knowledge, by which the search starts.
PHONE_SEEDS = (r"\+9+([ -]9+)+", r"\(999\) 999-9999", r"999-999-9999", r"99999 999999")
IDENTITY_SEEDS = (r"A{2}9{6,8}", r"9999-9999-9999", r"A{2}99/9{5}", r"A{2}-99-9{5}-A")
MAIL_SEEDS = (r"mail w(?:\.w)*@w(?:\.w)+",)
ADDRESS_SEEDS = (r"addr (?:Flat|Plot|Door) .*", r"addr P\.O\. .*")
# Words that put another person behind the patient's own name.
RELATED = r"\b(?:wife|husband|son|daughter|mother|father|care|child) of\b"


_SHAPES = {c: "9" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" for c in range(128) if chr(c).isalnum()}


def _shape(value: str) -> str:
    return value.translate(_SHAPES)


_SEED_SHAPES = tuple(
    (re.compile(p), kind) for ps, kind in ((PHONE_SEEDS, "phone"), (IDENTITY_SEEDS, "identity"), (MAIL_SEEDS, "email"), (ADDRESS_SEEDS, "address")) for p in ps
)


def _form(kind: str, value: str) -> str:
    """Shape of a candidate: characters of a number, separators of a mail address, house
    word, numbers and words of an address."""
    if kind == "num":
        return _shape(value)
    if kind == "mail":
        return "mail " + re.sub(r"[\w+-]+", "w", value)
    house = re.match(r"(?:Flat|Plot|House|Door|H\.|P\.\s?O\.)", value)
    rest = value[house.end() :] if house else value
    street = re.search(r"(?:strasse|straße|gasse|weg|platz)\s", rest)
    return f"addr {house.group().replace(' ', '') if house else ''}{'street' if street and not house else ''} " + re.sub(r"(?:w ?)+", "w ", re.sub(r"[^\W\d_]+", "w", re.sub(r"\d+", "9", rest)))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a house to its postal code: each code is looked back from, up to the
    code before it, so a text is passed once."""
    begin = 0
    for code in _CODE.finditer(text):
        m = _TO_CODE.search(text[begin : code.end()])
        if m:
            yield begin + m.start(), code.end()
            begin = code.end()
    for m in _STREETS.finditer(text):
        yield m.span()


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Addresses, mail addresses and numbers, without overlaps; each pattern runs only
    where the text holds what it needs."""
    taken: list[tuple[int, int]] = []
    found = [("addr", s, e) for s, e in _addresses(text)] if _HAS_POSTAL.search(text) else []
    if "@" in text or "(at)" in text or "[at]" in text or " dot " in text:
        found += [("mail", *m.span()) for m in _SPAN["mail"].finditer(text)]
    found += [("num", *m.span()) for m in _SPAN["num"].finditer(text)]
    for kind, s, e in found:
        at = bisect(taken, (s, e))
        free = (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e)
        if e - s >= MIN_DIGITS and free:
            insort(taken, (s, e))
            yield kind, s, e


_TITLE_SET = frozenset(TITLES)
_DOCTOR = frozenset(("dr", "prof", "doctor", "professor"))
_GLUED = re.compile(r"(?:dr|prof|mr|mrs)\.")
_DIGIT = re.compile(r"\d")
_BEHIND = re.compile(rf"\S*/\S*|[\d(]|{RELATED}", re.I)


def _left(text: str, at: int) -> tuple[str, str, str]:
    """(two words before, one word before, title) left of a place in its sentence."""
    # the words of the line up to here, from a stretch that grows until it holds enough of them
    line, size = text.rfind("\n", 0, at) + 1, 60
    while True:
        begin = max(line, at - size)
        words = text[begin:at].lower().split()
        if begin == line or len(words) > 5:
            break
        size *= 4
    title = ""
    while words:
        last = words[-1].strip(".")
        if last not in _TITLE_SET:
            break
        title = "dr" if last in _DOCTOR else "mr"
        words.pop()
    if words and _GLUED.match(words[-1]):
        words.pop()
    if words and words[-1][-1] in ".;!?" and len(words[-1]) > 4:
        words = []
    if not words:
        return "^", "^", title
    words = [_DIGIT.sub("9", w.strip("([/,")).rstrip(":.") or w for w in words[-2:]]
    return " ".join(words), words[-1], title


class _Words:
    """(word, start, end) by number, taken from the matches when asked for."""

    def __init__(self, found: Iterator[re.Match]) -> None:
        self.found = list(found)
        self.read: dict[int, tuple[str, int, int]] = {}

    def __getitem__(self, k: int) -> tuple[str, int, int]:
        got = self.read.get(k)
        if got is None:
            m = self.found[k]
            got = self.read[k] = (m.group(), m.start(), m.end())
        return got


def _names(text: str, common: frozenset, given: frozenset, skip: frozenset, own: frozenset, taken: list[tuple[int, int]]):
    """Runs of uncommon words: (value, short value, first words, left context, seed)."""
    words = _Words(_WORD.finditer(text))
    hits = [k for k, m in enumerate(words.found) if m.group().lower() not in skip]
    n, i, at_hit = len(words.found), 0, 0

    def plain(k: int) -> bool:
        w = words[k][0].lower()
        return w in common or w in TITLES or w in DEGREES

    while True:
        while at_hit < len(hits) and hits[at_hit] < i:
            at_hit += 1
        if at_hit == len(hits):
            return
        i = hits[at_hit]
        w, s, e = words[i]
        low = w.lower()
        initial = len(w) == 1 and (w.isupper() or text[e : e + 1] == "." or (i and words[i - 1][0].lower() in TITLES) or text[s - 2 : s] in (": ", ". ", "- "))
        if (low in common and low not in given and not initial) or low in TITLES or low in DEGREES or any(a <= s < b for a, b in taken):
            i += 1
            continue
        if len(w) == 1 and not initial:
            i += 1
            continue
        run, comma = [i], False
        long = int(len(w) > 1)
        while run[-1] + 1 < n:
            j = run[-1] + 1
            gap = text[words[run[-1]][2] : words[j][1]]
            if gap not in (" ", "  ", ". ", ".  ", ", ", ",  ", ".", "-"):
                break
            if gap == "." and len(words[run[-1]][0]) > 1:
                break
            if gap.startswith(".") and len(words[run[-1]][0]) > 1:
                break
            if gap.startswith(","):
                if comma or long != 1:
                    break
                comma = True
            if plain(j) and words[j][0].lower() not in given:
                if len(words[j][0]) > 1:
                    break
                if not words[j][0].isupper() and text[words[j][2] : words[j][2] + 1] != ".":
                    break
            run.append(j)
            long += len(words[j][0]) > 1
        if not long:
            i += 1
            continue
        last = words[run[-1]]
        if text[words[run[-1]][1] - 1 : words[run[-1]][1]] == "," or (comma and len(run) == 1):
            run = run[:1]
            last = words[run[-1]]
        end = last[2] + (text[last[2] : last[2] + 1] == "." and len(last[0]) == 1)
        full = text[s:end]
        # the run cut after the second long word, and after the first
        cut_two, longs = end, 0
        for k in run:
            longs += len(words[k][0]) > 1
            if longs == 2:
                cut_two = words[k][2]
                break
        low_words = [words[k][0].lower() for k in run if len(words[k][0]) > 1]
        two = bool(low_words) and (low_words[0] in given or len(words[run[0]][0]) == 1 or (len(low_words) > 1 and low_words[1] in given and comma))
        known = any(x in own or x in given for x in low_words)
        if i and not plain(i - 1) and text[words[i - 1][1] - 1] != "/" and text[words[i - 1][2] : s].strip(" ,.'-") == "":
            i = run[-1] + 1
            continue
        yield s, full, text[s:cut_two], text[s : words[run[0]][2]] if len(words[run[0]][0]) > 1 else text[s:cut_two], two, known
        i = run[-1] + 1 if known or len(run) == 1 else i + 1
        if known and longs >= 2 and cut_two < end:
            while i > run[0] + 1 and words[i - 1][1] >= cut_two:
                i -= 1


def common_words(texts: DataFrame, given: list[str], share: float = COMMON_SHARE) -> list[str]:
    """Words, lower case, that stand in at least ``share`` of all texts and seldom next
    to a title, given name or initial: counted per batch in Python, summed by Spark
    over all texts."""
    known = texts.sparkSession.sparkContext.broadcast(frozenset(given) | frozenset(TITLES))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beside = known.value
        for b in batches:
            c: Counter = Counter()
            named: Counter = Counter()
            for t in b["text"]:
                low = t.lower().translate(_NON_WORD).split()
                c.update(set(low))
                named.update({y for x, y in zip(low, low[1:]) if x in beside or (len(x) == 1 and x.isalpha() and x not in "ax")})
            yield pd.DataFrame({"word": list(c), "n": list(c.values()), "named": [named[w] for w in c]})

    counted = (
        texts.select("text").mapInPandas(count, "word string, n bigint, named bigint")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("named").alias("named"))
    )
    total = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = counted.where((F.col("n") >= F.greatest(total * share, F.lit(3))) & (F.col("named") < 0.25 * F.col("n")))
    return [r.word for r in kept.select("word").collect()]


def texts_of(records: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """``place, key, text, own``: the texts to search; own holds the names that the row
    itself gives for patient and referrer.  Null keys and null or empty texts are left out."""
    own = F.concat_ws(" ", "patient", "referrer")
    report = records.select(F.lit("report_text").alias("place"), F.col("id").alias("key"), F.col("report_text").alias("text"), own.alias("own"))
    patient = records.select(F.lit("patient").alias("place"), F.col("id").alias("key"), F.col("patient").alias("text"), F.lit("").alias("own"))
    spoken = transcriptions.select(F.lit("transcript").alias("place"), F.col("transcript_id").cast("string").alias("key"), "text", F.lit("").alias("own"))
    return report.unionByName(patient).unionByName(spoken).where("key is not null and text <> ''")


def _list_of(words: Column, df: DataFrame) -> list[str]:
    got = df.select(F.lower(F.trim(words)).alias("w")).where("length(w) > 1").distinct().limit(MAX_LIST + 1).collect()
    if len(got) > MAX_LIST:
        raise ValueError(f"more than {MAX_LIST} given names")
    return [r.w for r in got]


def _finder(known):
    """The pass over the texts; ``known.value`` holds common words and given names."""
    columns = [c.split()[0] for c in CANDIDATES.split(", ")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, first = known.value
        skip = frozenset(w for w in words if len(w) > 1 and w not in first) | frozenset([*TITLES, *DEGREES, *NUMBER_WORDS])
        for b in batches:
            out = []
            for place, key, text, own in zip(b["place"], b["key"], b["text"], b["own"], strict=True):
                own_end, spoken = 0, "~" * (place == "transcript")
                if place == "patient":
                    # the patient's own name ends where a relation, number or bracket begins
                    cue = _BEHIND.search(text)
                    if not cue:
                        continue
                    own_end = cue.end()
                taken: list[tuple[int, int]] = []
                for kind, start, end in _spans(text):
                    value = text[start:end]
                    if kind == "num":
                        value = value.rstrip("-. (")
                        if value[0] == "(" and (")" not in value or value[-1] == ")"):
                            value = value[1:].rstrip(")")
                        if "(" not in value:
                            value = value.rstrip(")")
                        if sum(c.isdigit() for c in value) < MIN_DIGITS:
                            continue
                    p2, p1, _ = _left(text, start)
                    shape = _form(kind, value)
                    seed = next((k for p, k in _SEED_SHAPES if p.fullmatch(shape)), "")
                    taken.append((start, end))
                    out.append((place, key, kind, value, value, shape, p2, p1, seed))
                own_words = frozenset(w.lower() for w in _WORD.findall(own) if len(w) > 3) - frozenset(TITLES)
                for at, full, two, one, is_two, seed in _names(text, words, first, skip, own_words, taken):
                    p2, p1, title = _left(text, at)
                    if at < own_end:
                        continue
                    out.append((place, key, "name", full if place != "transcript" else two, one, "2" if is_two else "1", f"{p2}|{title}{spoken}", f"{p1}|{title}{spoken}", "name" if seed else ""))
            yield pd.DataFrame(out, columns=columns)

    return find


def candidates(texts: DataFrame, common: list[str], given: list[str]) -> DataFrame:
    """Candidate instances with their contexts (see ``CANDIDATES``)."""
    known = texts.sparkSession.sparkContext.broadcast((frozenset(common), frozenset(given)))
    return texts.mapInPandas(_finder(known), CANDIDATES)


def score_shapes(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``shape, kind, cover``: shapes of numbers, mail addresses and addresses that
    confident patterns mark."""
    edges = cut(
        found.where("type <> 'name'").select("shape", "seed", F.explode(F.array(F.concat(F.lit("2:"), "p2"), F.concat(F.lit("1:"), "p1"))).alias("pattern"))
        .groupBy("shape", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    )
    labels = edges.where("seed <> ''").groupBy("shape").agg(F.max("seed").alias("kind")).withColumn("cover", F.lit(1.0))
    for _ in range(rounds):
        labels = cut(labels)
        votes = edges.join(labels, "shape").groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
        totals = votes.groupBy("pattern").agg(F.sum("n").alias("all"))
        good = votes.join(totals, "pattern").where((F.col("n") >= MIN_SUPPORT) & (F.col("n") >= MIN_PURITY * F.col("all"))).select("pattern", "kind")
        size = edges.where("pattern like '1:%'").groupBy("shape").agg(F.sum("n").alias("size"))
        reached = (
            edges.where("pattern like '2:%' or pattern like '1:%'").join(good, "pattern").groupBy("shape", "kind", F.substring("pattern", 1, 1).alias("level"))
            .agg(F.sum("n").alias("n")).groupBy("shape", "kind").agg(F.max("n").alias("n")).join(size, "shape")
            .withColumn("cover", F.col("n") / F.col("size"))
        )
        best = reached.groupBy("shape").agg(F.max(F.struct("cover", "kind")).alias("b")).select("shape", "b.kind", "b.cover").where(F.col("cover") >= MIN_COVER)
        labels = labels.select("shape", "kind", "cover").unionByName(best.join(labels, "shape", "left_anti"))
    return labels


def score_names(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, share, two``: context patterns with the part of their instances that
    are names, and the part of those that begin with a given name."""
    runs = found.where("type = 'name'").withColumn("instance", F.lower("value"))
    edges = cut(
        runs.select("instance", "seed", "shape", F.explode(F.array(F.concat(F.lit("2:"), "p2"), F.concat(F.lit("1:"), "p1"))).alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.count(F.lit(1)).alias("n"), F.max((F.col("seed") == "name").cast("double")).alias("known"), F.max((F.col("shape") == "2").cast("double")).alias("two"))
    )
    patterns = None
    for _ in range(rounds):
        if patterns is None:
            scored = edges.withColumn("s", F.col("known"))
        else:
            lifted = (
                edges.join(patterns.select("pattern", "share"), "pattern", "left").groupBy("instance")
                .agg(F.round(F.sum(F.coalesce("share", F.lit(0.0)) * F.col("n")) / F.sum("n"), 6).alias("lift"))
            )
            scored = edges.join(lifted, "instance", "left").withColumn("s", F.greatest("known", F.coalesce("lift", F.lit(0.0))))
        patterns = cut(
            scored.groupBy("pattern").agg(
                F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("share"), F.sum("n").alias("n"),
                (F.sum(F.col("two") * F.col("n")) / F.sum("n")).alias("two"),
            ).where((F.col("n") >= MIN_SUPPORT) & (F.col("share") > 0))
        )
    return patterns


def _small(df: DataFrame) -> DataFrame:
    """The table for a broadcast if a count finds it small, else as it is (skewed keys
    are then split by adaptive execution)."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def identifiers(records: DataFrame, transcriptions: DataFrame, aliases: DataFrame, directory: DataFrame) -> DataFrame:
    """``place, key, kind, value``: one row per distinct value in a text.

    Texts are searched whole; repeated rows count once; null and empty texts give no
    rows, and so do texts in which nothing is found."""
    texts = texts_of(records, transcriptions)
    given = sorted(
        set(_list_of(F.col("given_name"), aliases)) | set(_list_of(F.col("short_name"), aliases))
        | set(_list_of(F.regexp_extract("full_name", r"^(?:Dr\.?\s+)?(\p{L}+)", 1), directory))
    )
    found = cut(candidates(texts, common_words(texts.where("place <> 'patient'"), given), given))
    shapes, patterns = _small(score_shapes(found)), score_names(found)
    shaped = found.where("type <> 'name'").join(shapes, "shape").select("place", "key", "kind", "value")
    # a pattern of two words that is known to hold no names must still keep the one-word pattern out
    side = lambda level: _small(patterns.where(F.col("pattern").startswith(f"{level}:") & ((F.col("n") >= 3) | (F.col("share") >= MIN_NAME_SHARE)))).select(
        F.substring("pattern", 3, 10_000).alias(f"p{level}"), F.col("share").alias(f"share{level}"), F.col("n").alias(f"n{level}"), F.col("two").alias(f"two{level}")
    )
    named = found.where("type = 'name'").join(side(2), "p2", "left").join(side(1), "p1", "left")
    sure = F.col("n2") >= 3
    share, two = F.when(sure, F.col("share2")).otherwise(F.col("share1")), F.when(sure, F.col("two2")).otherwise(F.col("two1"))
    names = (
        named.withColumns({"share": share, "two": two}).where(F.col("share") >= MIN_NAME_SHARE)
        .select(
            "place", "key", F.lit("name").alias("kind"),
            F.when((F.col("place") == "transcript") & (F.col("shape") == "1") & (F.col("two") < 0.6), F.col("short")).otherwise(F.col("value")).alias("value"),
        )
    )
    return shaped.unionByName(names).distinct()


def redacted(records: DataFrame, transcriptions: DataFrame, aliases: DataFrame, directory: DataFrame) -> DataFrame:
    """``place, key, text`` with every identifier replaced by ``[KIND]``, longest first.

    Texts without identifiers come out as they are; repeated rows once."""
    texts = texts_of(records, transcriptions).select("place", "key", "text").distinct()
    marks = identifiers(records, transcriptions, aliases, directory).groupBy("place", "key").agg(
        F.sort_array(F.collect_set(F.struct(F.length("value").alias("l"), "value", "kind")), asc=False).alias("marks")
    )
    swap = F.aggregate("marks", F.col("text"), lambda t, m: F.replace(t, m.value, F.concat(F.lit("["), F.upper(m.kind), F.lit("]"))))
    return texts.join(marks, ["place", "key"], "left").select("place", "key", F.when(F.col("marks").isNull(), F.col("text")).otherwise(swap).alias("text"))
