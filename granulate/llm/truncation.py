"""Problem 1: texts cut off by field limits or broken transfers.

A stack automaton reads every text and reports what is left open at its end:
brackets, quotes, markup, an escape or a multibyte sequence broken off. A text
without a terminator is judged by its site's baseline: the odds that such a text
there is a cut one rather than a whole one. Where sites leave both possible, the
whole collection tells how often the last tokens of the text are followed by a
terminator and how often by more text; that likelihood ratio times the site's
odds decides. The lengths at which a site's texts pile up (field limits) decide the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions import normalise
from granulate.session import cut, spread

ORDERS = (4, 2, 1)  # context lengths, the longest known one speaks
KNOWN = 3  # times a context must occur inside texts to be known
CLEAR = 0.02  # share of ends among a context's occurrences up to which a text clearly does not end there
WHOLE = 0.5  # share from which it may clearly end there
SURE = 200.0  # odds that a clear context gives
FLUSH = 400_000  # contexts a task holds before it passes them on

# Bracket pairs, quote pairs, terminators and marks that say "more follows".
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
TERMINATORS = ".!?"
ELLIPSES = ("...", "…", "[..]", "[…]")

TOKEN = re.compile(r"[A-Za-z]?\d+(?:[.,]\d+)*[a-z]?|[^\W\d_]+(?:['’-][^\W\d_]+)*|[^\w\s]|_")
BROKEN_END = re.compile(
    "(?:�"  # a multibyte sequence that could not be decoded
    r"|&(?:#[0-9]{0,7}|#[xX][0-9a-fA-F]{0,6}|[A-Za-z][A-Za-z0-9]{1,7})?"  # an entity without its semicolon
    r"|(?<![\d\s])%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?)\Z"  # an escape
)
LONGEST = 12  # characters that such an end has at most
BROKEN_TAG = re.compile(r"<[/!]?(?:[A-Za-z][^<>]*)?\Z")
STACKED = re.compile("[()\\[\\]{}“”«»\"]")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "wbr"}


def tokens(text: str) -> list[str]:
    """Words, numbers and marks; figures are written alike (sample V49 -> X#)."""
    out = []
    for t in TOKEN.findall(text):
        if any(ch.isdigit() for ch in t):
            t = ("X" if t[0].isalpha() else "") + "#" + ("x" if t[-1].isalpha() and len(t) > 1 else "")
        out.append(t)
    return out


def left_open(text: str) -> bool:
    """Whether the automaton ends with something unclosed or broken off."""
    end = text.rstrip()
    if BROKEN_END.search(end, max(0, len(end) - LONGEST)) or (at := end.rfind("<")) >= 0 and BROKEN_TAG.match(end, at):
        return True
    stack: list[str] = []
    for m in TAG.finditer(text):
        name = m.group(2).lower()
        if m.group(1):
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif not m.group(3) and name not in VOID:
            stack.append(name)
    if stack:
        return True
    for m in STACKED.finditer(text):
        i, ch = m.start(), m.group()
        if ch in "([{“«":
            stack.append(ch)
        elif ch in PAIRS:
            if stack and stack[-1] == PAIRS[ch]:
                stack.pop()
        elif ch == '"':
            if stack and stack[-1] == ch:
                stack.pop()
            elif i == 0 or not text[i - 1].isdigit():
                stack.append(ch)
    return bool(stack)


def _is_end(t: list[str], i: int) -> bool:
    """Token i is a terminator that closes a sentence: the text or a new sentence follows."""
    return t[i] in TERMINATORS and (i + 1 == len(t) or t[i + 1][0].isupper() or t[i + 1] in "(<[\"“")


def context_counts(texts: DataFrame, column: str) -> DataFrame:
    """ctx (hash), ends, goes: how contexts inside the texts go on, over all rows.

    Tasks combine before the shuffle. The end of a text itself says nothing, as
    it may be a cut.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, goes = Counter(), Counter()

        def flush() -> pd.DataFrame:
            keys = list(ends.keys() | goes.keys())
            out = pd.DataFrame(
                {"ctx": [_hash(k) for k in keys], "ends": [ends[k] for k in keys], "goes": [goes[k] for k in keys]}
            )
            ends.clear()
            goes.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                t = tokens(text)
                for i in range(len(t) - 1):
                    into = ends if _is_end(t, i + 1) else goes
                    for k in ORDERS:
                        if i + 1 >= k:
                            into[tuple(t[i + 1 - k : i + 1])] += 1
            if len(ends) + len(goes) > FLUSH:
                yield flush()
        yield flush()

    return (
        texts.select(F.col(column).alias("text")).mapInPandas(count, "ctx long, ends long, goes long")
        .groupBy("ctx").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    )


def _hash(key: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(key)) - (1 << 63)


def endings(captions: DataFrame) -> DataFrame:
    """What each text's end looks like: flags, lengths and the hashes of its last tokens."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["caption"]:
                end = text.rstrip()
                dots = end.endswith(ELLIPSES)
                term = end[-1:] in TERMINATORS and not dots
                t = tokens(end[:-1] if term else end)
                last = next((i for i in range(len(t) - 2, -1, -1) if _is_end(t, i)), -1)
                stub = not term and sum(x[0].isalnum() for x in t[last + 1 :]) < 2 and last >= 0
                ctx = [_hash(tuple(t[-k:])) if len(t) >= k else 0 for k in ORDERS]
                rows.append((len(text), len(text.encode("utf-8", "replace")), text != end, dots or left_open(text), term, stub, *ctx))
            out = pd.DataFrame(rows, columns=["chars", "bytes", "gap", "open", "term", "stub", "c0", "c1", "c2"])
            yield pd.concat([pdf[["row_no", "site"]].reset_index(drop=True), out], axis=1)

    return captions.select("row_no", "site", "caption").mapInPandas(
        look,
        "row_no long, site string, chars int, bytes int, gap boolean, open boolean, term boolean, stub boolean, c0 long, c1 long, c2 long",
    )


def with_site(images: DataFrame, sources: DataFrame) -> DataFrame:
    """row_no, site, caption: host of source_url, else the source's domain, else NULL.

    Of several rows of a source the last read one that names a domain counts.
    Rows without a caption or row_no are left out.
    """
    rows = spread(images.select("row_no", "source_id", "source_url", "caption")).select(
        "row_no",
        normalise.ident(F.col("source_id")).alias("source_id"),
        normalise.url_host(F.col("source_url")).alias("host"),
        "caption",
    ).where((F.trim("caption") != "") & F.col("row_no").isNotNull())
    domains = (
        sources.select(normalise.ident(F.col("source_id")).alias("source_id"), normalise.url_host(F.col("domain")).alias("domain"), "accessed_at", "row_no")
        .where("source_id is not null and domain is not null")
        .groupBy("source_id").agg(F.max_by("domain", F.struct("accessed_at", "row_no")).alias("domain"))
    )
    named = rows.where("host is not null").select("row_no", F.col("host").alias("site"), "caption")
    rest = rows.where("host is null").join(domains, "source_id", "left").select("row_no", F.col("domain").alias("site"), "caption")
    return named.unionByName(rest)


def judged(captions: DataFrame) -> DataFrame:
    """row_no, site, cut (boolean) and why for every caption.

    why: structure, missing terminator (unterminated at a site whose unterminated texts are mostly cut), text goes on
    (unterminated elsewhere, by its last tokens), abbreviation goes on (terminated where no sentence ends), field limit.
    A NULL site is a site of its own. Blank captions are not rows of `captions`.
    """
    ends = cut(endings(captions))  # read several times below
    counts = cut(context_counts(captions, "caption"))
    keys = ends.select("c0", "c1", "c2").distinct()
    long = keys.select("c0", "c1", "c2", F.posexplode(F.array("c0", "c1", "c2")).alias("o", "ctx")).where("ctx != 0")
    known = (
        long.join(counts, "ctx")
        .groupBy("c0", "c1", "c2")
        .agg(F.min_by(F.struct("ends", "goes"), F.when(F.col("ends") + F.col("goes") >= KNOWN, F.col("o"))).alias("best"))
        .select("c0", "c1", "c2", "best.*", (F.col("best.ends") / (F.col("best.ends") + F.col("best.goes"))).alias("p"))
    )
    total = counts.agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")).first()
    usual = (total["ends"] or 1) / max(total["goes"] or 1, 1)
    bare = ~F.col("term") & ~F.col("open")
    # No known context is clear too: words broken off are seen nowhere else.
    clear = F.coalesce(F.col("p") <= CLEAR, F.lit(True)) | F.col("stub")
    odds = F.when(clear, SURE).otherwise(F.col("goes") / F.greatest("ends", F.lit(1)) * usual)
    marked = ends.join(known, ["c0", "c1", "c2"], "left").select("*", F.coalesce("site", F.lit("")).alias("at"), (bare & clear).alias("seems_cut"), (bare & ~clear & (F.col("p") >= WHOLE)).alias("seems_whole"), odds.alias("odds"))
    rows = marked.join(baselines(marked), "at").select(
        "row_no", "site", "chars", "bytes", "gap", "open", "term", "baseline",
        # Unterminated: the site's odds times those of the context. Terminated: a dot that never ends a sentence there.
        F.when(F.col("term"), F.coalesce((F.col("p") < CLEAR) & (F.col("ends") + F.col("goes") >= 20), F.lit(False)))
        .otherwise(F.col("stub") | (F.col("baseline") * F.col("odds") > 1))
        .alias("goes_on"),
    )
    limits = field_limits(rows).withColumnsRenamed({"unit": "lunit", "size": "lsize"})
    at = F.col("site").eqNullSafe(F.col("lsite")) & (F.col("unit") == F.col("lunit")) & (F.col("size") == F.col("lsize"))
    here = sized(rows, "row_no", "open", "gap", "baseline").join(limits, at, "left")
    why = (
        F.when(F.col("open"), "structure")
        .when(F.col("goes_on"), F.when(F.col("term"), "abbreviation goes on").when(F.col("baseline") > 1, "missing terminator").otherwise("text goes on"))
        .when(F.col("lsize").isNotNull() & (F.col("gap") | (~F.col("term") & F.col("cut_ends"))), "field limit")
    )
    return (
        here.groupBy("row_no", "site").agg(F.max(why).alias("why"))
        .select("row_no", "site", F.col("why").isNotNull().alias("cut"), "why")
    )


def baselines(marked: DataFrame) -> DataFrame:
    """at (site, blank for NULL) and baseline: odds that an unterminated text of the site is cut, from those that are clearly cut or whole."""
    return marked.groupBy("at").agg(((F.count_if("seems_cut") + 1) / (F.count_if("seems_whole") + 1)).alias("baseline"))


def sized(rows: DataFrame, *more: str) -> DataFrame:
    """site, goes_on, term and `more` of every row, once for its size in chars and once for that in bytes."""
    units = F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))
    return rows.select("site", "goes_on", "term", *more, F.explode(units).alias("unit", "size"))


def field_limits(rows: DataFrame, least: int = 5, peak: float = 5.0) -> DataFrame:
    """Field limits by site: lsite, unit (chars or bytes), size, cut_ends.

    A limit is a length at which texts that go on pile up, `peak` times over the
    mean of the ten lengths below; a site may have several (the NULL site mixes
    sites). Where it is not the site's largest pile, most unterminated texts of
    that length must go on, as lengths that whole texts share pile up too.
    cut_ends: unterminated texts at the limit that could be whole are
    more than twice what the site's share of unpunctuated texts lets expect there.
    """
    per = sized(rows).groupBy("site", "unit", "size").agg(
        F.count_if(F.col("goes_on") & ~F.col("term")).alias("cuts"),
        F.count_if(~F.col("goes_on") & ~F.col("term")).alias("bare"),
        F.count_if(F.col("term")).alias("full"),
    )
    w = Window.partitionBy("site", "unit")  # a row a length, however many texts
    near = F.coalesce(F.sum("cuts").over(w.orderBy("size").rangeBetween(-10, -1)), F.lit(0)) / 10
    return (
        per.select("*", near.alias("near"), F.sum("bare").over(w).alias("all_bare"), F.sum("full").over(w).alias("all_full"), F.max(F.struct("cuts", "size")).over(w)["size"].alias("largest"))
        .where((F.col("cuts") >= least) & (F.col("cuts") >= peak * F.greatest("near", F.lit(0.2))) & ((F.col("size") == F.col("largest")) | (F.col("cuts") > F.col("bare"))))
        .select(
            F.col("site").alias("lsite"), "unit", "size",
            (F.col("bare") > 2 * F.col("full") * F.col("all_bare") / F.greatest("all_full", F.lit(1))).alias("cut_ends"),
        )
    )


def found(images: DataFrame, sources: DataFrame) -> DataFrame:
    """row_no of every row whose caption was cut."""
    return judged(with_site(images, sources)).where("cut").select("row_no")


def shares(images: DataFrame, sources: DataFrame) -> DataFrame:
    """site, captions, cut, share: how often each site cuts its captions."""
    return judged(with_site(images, sources)).groupBy("site").agg(
        F.count("*").alias("captions"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share")
    )
