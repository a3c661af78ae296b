"""Problem 5: several values packed in one field, one row per value with its position.

Line breaks, tabs, bars, dots and semicolons outside quotes always separate;
quoted spans and JSON lists are atomic. A comma, slash, ampersand or `and` may
separate or belong to a value. Expectation-maximisation over the lattice of
possible values learns from the whole column how often each value and each shape
of value occurs (forward and backward sums give expected counts, until the
likelihood settles), and a Viterbi pass picks the likeliest split.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulate.functions.normalise import TRIM
from granulate.session import cut

SETTLED = 1e-3  # relative gain of the log-likelihood below which the fit has settled
LIKELY = 0.5  # probability from which an arc counts; the crumbs of unlikely splits would add up over a large column
JOINED = 4  # possible separators up to which every span of a piece may be one value; longer ones must occur as a whole piece or atom in the column
WORD = 1e-3  # probability of a word of a value that was not seen
FLOOR = 1e-5  # probability of a shape that was not seen, times INNER for each separator inside it
INNER = 1e-6

HARD = "\n\r\t;|·•"
SOFT = re.compile(r"(?<!\s)(?:\s*,\s*(?:and|&)\s+|\s*,\s*|\s+(?:and|&)\s+|\s*/\s*|\s*&\s*)")
CLOSED = re.compile(rf" *(?:\Z|[{HARD},/&]|and )")  # what may follow a closing quote
CLOSER = {'"': '"', "“": "”", "«": "»"}


def pieces(text: str) -> list[tuple[str, bool]]:
    """(piece, atomic) in order; empty pieces are left out.

    A JSON list of scalars gives its elements. A quote opens a span only at the
    start of a piece; a doubled or escaped quote inside it stands for one. Quotes
    around the whole field only pack it.
    """
    t = text.strip()
    if t[:1] == "[" and t[-1:] == "]":
        try:
            got = json.loads(t)
        except ValueError:
            got = None
        if isinstance(got, list) and not any(isinstance(x, (list, dict)) for x in got):
            return [(s, True) for x in got if x is not None and (s := str(x).strip())]
        t = t[1:-1]
    out: list[tuple[str, bool]] = []
    start = i = 0

    def plain(a: int, b: int) -> None:
        p = t[a:b].strip()
        if out and out[-1][1]:
            m = SOFT.match(p)
            p = p[m.end() :].strip() if m and m.end() else re.sub(r"^(?:and|&)\s+", "", p)
        if p.strip(",/& "):
            out.append((p.strip(), False))

    while i < len(t):
        ch = t[i]
        if ch in HARD:
            plain(start, i)
            start = i = i + 1
            if out and out[-1][1]:
                out.append(("", False))  # a hard separator after a quoted span: what follows starts anew
            continue
        if ch not in CLOSER:
            i += 1
            continue
        before = t[start:i].rstrip()
        if (not before or before[-1] in ",/&" or before.endswith(" and")):
            j, inner = i + 1, []
            while j < len(t):
                if t[j] == "\\" and t[j + 1 : j + 2] in (CLOSER[ch], "\\"):
                    inner.append(t[j + 1])
                    j += 2
                elif t[j] == CLOSER[ch]:
                    if t[j + 1 : j + 2] == CLOSER[ch] == ch:
                        inner.append(ch)
                        j += 2
                    else:
                        break
                else:
                    inner.append(t[j])
                    j += 1
            if j < len(t) and CLOSED.match(t, j + 1):
                plain(start, i - (len(t[start:i]) - len(before)) if before else i)
                if out and not out[-1][1]:
                    out[-1] = (re.sub(r"(?:[,/&]|\s+and)\s*$", "", out[-1][0]).strip(), False)
                if value := "".join(inner).strip():
                    out.append((value, True))
                start = i = j + 1
                continue
        i += 1
    plain(start, len(t))
    out = [(p, q) for p, q in out if p]
    if len(out) == 1 and out[0][1] and t[-1:] in CLOSER.values():
        return [(out[0][0], False)]  # the whole field is quoted: the quotes pack it and say nothing of its parts
    return out


def units(piece: str) -> tuple[list[str], list[str]]:
    """Parts of a piece between possible separators, and the separators; empty parts are left out."""
    parts, seps, at = [], [], 0
    for m in SOFT.finditer(piece):
        part = piece[at : m.start()].strip()
        if part:
            parts.append(part)
            seps.append(m.group())
        elif seps:
            seps[-1] = m.group() if not parts else seps[-1]
        at = m.end()
    if tail := piece[at:].strip():
        parts.append(tail)
    return parts, seps[: max(0, len(parts) - 1)]


INITIALS = re.compile(r"^(?:[^\W\d_]\.-?)+$|^[A-Z]$")


def shape(value: str) -> str:
    """Shape of a value: words, initials and inner separators; name particles do not count."""
    out = []
    for t in re.findall(r",|/|&|\S+?(?=[,/&]|\s|$)", value):
        if t in ",/":
            k = t
        elif t in ("&", "and"):
            k = "+"
        elif INITIALS.match(t):
            k = "i"
        elif t[0].islower() and len(t) <= 3:
            k = "p"
        else:
            k = "W"
        if not (k == "i" and out and out[-1] == "i") and not (k == "W" and out[-4:] == ["W"] * 4) and not (k == "p" and out and out[-1] == "p"):
            out.append(k)
    return "".join(out)


def _join(parts: list[str], seps: list[str], i: int, j: int) -> str:
    """Parts i .. j - 1 with the separators between them."""
    return parts[i] + "".join(seps[k] + parts[k + 1] for k in range(i, j - 1))


def _lattice(lengths: list[int]):
    """Arcs of a piece: field_name, piece, i, j, value, shape, words, given.

    `given` arcs are possible values in any case: spans of up to JOINED
    separators and the piece as a whole. The others, of one of `lengths` parts, are
    kept only if the column knows them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, piece in zip(pdf["field_name"], pdf["piece"], strict=True):
                parts, seps = units(piece)
                n = len(parts)
                for size in range(1, min(n, JOINED + 1) + 1):
                    for i in range(n - size + 1):
                        value = _join(parts, seps, i, i + size)
                        rows.append((field, piece, i, i + size, value, shape(value), len(value.split()), True))
                if n > JOINED + 1:
                    rows.append((field, piece, 0, n, piece, shape(piece), len(piece.split()), True))
                for size in lengths:
                    for i in range(n - size + 1 if size < n else 0):
                        value = _join(parts, seps, i, i + size)
                        rows.append((field, piece, i, i + size, value, shape(value), len(value.split()), False))
            yield pd.DataFrame(rows, columns=["field_name", "piece", "i", "j", "value", "shape", "words", "given"])

    return run


def _log_p(e, n: float) -> float:
    """Log-probability of an arc: its value's share, and its shape's times that of its words."""
    unseen = FLOOR * INNER ** sum(e["shape"].count(x) for x in ",/+")
    a, b = (e["c"] or 0) / n, math.log(max((e["s"] or 0) / n, unseen, 1e-300)) + e["words"] * math.log(WORD)
    return max(b, math.log(a)) + math.log1p(math.exp(-abs(b - math.log(a)))) if a > 0 else b


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def expected(edges: list[dict], n: float) -> tuple[float, list[float]]:
    """Log-likelihood of a piece and the probability of every arc, summed over all its splits."""
    end = max(e["j"] for e in edges)
    lp = [_log_p(e, n) for e in edges]
    order = sorted(range(len(edges)), key=lambda k: (edges[k]["j"], edges[k]["i"]))
    fore, back = [0.0] + [-math.inf] * end, [-math.inf] * end + [0.0]
    for k in order:
        e = edges[k]
        fore[e["j"]] = _add(fore[e["j"]], fore[e["i"]] + lp[k])
    for k in sorted(order, key=lambda k: -edges[k]["i"]):
        e = edges[k]
        back[e["i"]] = _add(back[e["i"]], back[e["j"]] + lp[k])
    return fore[end], [math.exp(min(0.0, fore[e["i"]] + lp[k] + back[e["j"]] - fore[end])) for k, e in enumerate(edges)]


def likeliest(edges: list[dict], n: float) -> list[str]:
    """Values of the likeliest split; ties go to the one with the later first boundary."""
    end = max(e["j"] for e in edges)
    score, back = [0.0] + [-math.inf] * end, [None] * (end + 1)
    for e in sorted(edges, key=lambda e: (e["j"], e["i"])):
        s = score[e["i"]] + _log_p(e, n)
        if s > score[e["j"]]:
            score[e["j"]], back[e["j"]] = s, e
    values, at = [], end
    while at:
        values.append(back[at]["value"])
        at = back[at]["i"]
    return values[::-1]


def _settled(piece: str, atomic: bool) -> dict:
    """A piece without inner separators is a value, less the ones around it."""
    parts = [piece] if atomic else units(piece)[0]
    return {"piece": parts[0] if len(parts) == 1 else piece, "atomic": len(parts) == 1}


def _parsed(texts: DataFrame) -> DataFrame:
    """text with its pieces: array<struct<piece, atomic>>."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pieces=[[_settled(p, q) for p, q in pieces(t)] for t in pdf["text"]])

    return texts.mapInPandas(parse, "field_name string, text string, n long, pieces array<struct<piece:string,atomic:boolean>>")


def split_fields(df: DataFrame, key: str, fields: list[str], settled: float = SETTLED) -> DataFrame:
    """key, field_name, pos (from 1), item for every value packed in `fields` of `df`.

    NULL, blank and separator-only fields give no row. Every distinct text is
    split once; repeated rows each get its values. Ties go to the split with the
    later first boundary. Extra columns are ignored; `key` should be unique.
    """
    long = df.select(
        F.col(key),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x"),
    ).select(key, "x.*").where(F.regexp_replace("text", TRIM, "") != "")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = cut(_parsed(long.groupBy("field_name", "text").agg(F.count("*").alias("n")).repartition(tasks)))
    exploded = parsed.select("field_name", "n", F.explode("pieces").alias("p"), (F.size("pieces") > 1).alias("beside")).select("field_name", "n", "p.piece", "p.atomic", "beside")
    to_shape = F.pandas_udf(lambda s: s.map(shape), "string")
    value = F.col("piece").alias("value")
    atoms = cut(exploded.where("atomic").groupBy("field_name", value).agg(F.sum("n").cast("double").alias("c")).withColumn("shape", to_shape("value")))
    # To start with, what stands beside hard separators is half believed to have the shape of one value.
    start = exploded.where("not atomic and beside").groupBy("field_name", value).agg((F.sum("n") / 2).alias("c")).withColumn("shape", to_shape("value"))
    open_ = cut(exploded.where("not atomic").groupBy("field_name", "piece").agg(F.sum("n").alias("n")).repartition(tasks))
    # Values of more parts than JOINED allows that the column shows whole, and the numbers of parts they have.
    parts = F.pandas_udf(lambda s: s.map(lambda x: len(units(x)[0])), "int")
    whole = cut(
        atoms.select("field_name", "value").unionByName(open_.select("field_name", value)).distinct()
        .withColumn("parts", parts("value")).where(F.col("parts") > JOINED + 1)
    )
    lengths = sorted(r[0] for r in whole.select("parts").distinct().collect())  # distinct numbers, at most one a length
    spans = open_.select("field_name", "piece").mapInPandas(
        _lattice(lengths), "field_name string, piece string, i int, j int, value string, shape string, words int, given boolean"
    )
    arcs = spans.where("given").unionByName(spans.where("not given").join(whole.select("field_name", "value"), ["field_name", "value"], "left_semi"), allowMissingColumns=True) if lengths else spans
    # What a piece itself brings to a count says nothing of the piece, so `own` is taken off again. At
    # first this concerns pieces of many parts, which must not be held for values because they stand whole.
    arcs = cut(arcs.drop("given").withColumn("own", F.when((F.col("i") == 0) & (F.col("j") > JOINED + 1) & (F.col("value") == F.col("piece")), F.lit(math.inf)).otherwise(0.0)))

    def lattices(arcs: DataFrame, counts: DataFrame, shapes: DataFrame) -> DataFrame:
        """A row a piece with its arcs, the counts of their values (c) and shapes (s), and all counts of the field."""
        total = counts.groupBy("field_name").agg(F.greatest(F.sum("c"), F.lit(1.0)).alias("total"))  # a row a field
        own = F.when(F.col("j") - F.col("i") > JOINED + 1, F.col("own")).otherwise(0.0)
        rest = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)) - own).alias(c)
        return (
            arcs.join(counts.select("field_name", "value", "c"), ["field_name", "value"], "left")
            .join(shapes.select("field_name", "shape", "s"), ["field_name", "shape"], "left")
            .groupBy("field_name", "piece").agg(F.collect_list(F.struct("i", "j", "value", "shape", "words", rest("c"), rest("s"))).alias("arcs"))
            .join(F.broadcast(total), "field_name", "left").withColumn("total", F.coalesce("total", F.lit(1.0)))
        )

    shaped = lambda rows: rows.groupBy("field_name", "shape").agg(F.sum("c").alias("s"))
    e_step = F.pandas_udf(_each(expected), "struct<z:double,p:array<double>>")
    counts, shapes, before = atoms, shaped(atoms.select("field_name", "shape", "c").unionByName(start.select("field_name", "shape", "c"))), None
    while True:
        fitted = cut(lattices(arcs, counts, shapes).withColumn("fit", e_step("arcs", "total")).join(open_, ["field_name", "piece"]))
        now = fitted.agg(F.sum(F.col("n") * F.col("fit.z"))).first()[0]
        arcs = fitted.select("field_name", "piece", "n", F.inline(F.arrays_zip("arcs", F.col("fit.p").alias("p")))).select(
            "field_name", "piece", *[F.col(f"arcs.{c}").alias(c) for c in ("i", "j", "value", "shape", "words")], (F.col("n") * F.when(F.col("p") >= LIKELY, F.col("p")).otherwise(0.0)).alias("own")
        )
        counts = cut(
            arcs.select("field_name", "value", "shape", F.col("own").alias("c")).unionByName(atoms.select("field_name", "value", "shape", "c"))
            .where("c > 0").groupBy("field_name", "value").agg(F.any_value("shape").alias("shape"), F.sum("c").alias("c"))
        )
        shapes = shaped(counts)
        # The likelihood is bounded, so gains of this size end.
        if now is None or before is not None and now - before <= settled * abs(before):
            break
        before = now
    best = F.pandas_udf(_each(likeliest), "array<string>")
    chosen = lattices(arcs, counts, shapes).select("field_name", "piece", best("arcs", "total").alias("values"))
    items = (
        parsed.select("field_name", "text", F.posexplode("pieces").alias("at", "p")).select("field_name", "text", "at", "p.piece", "p.atomic")
        .join(chosen.withColumn("atomic", F.lit(False)), ["field_name", "piece", "atomic"], "left")
        .select("field_name", "text", "at", F.coalesce("values", F.array("piece")).alias("v"))
        .groupBy("field_name", "text")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])).alias("items"))
    )
    return (
        long.join(items, ["field_name", "text"])
        .select(key, "field_name", F.posexplode("items").alias("pos", "item"))
        .select(key, "field_name", (F.col("pos") + 1).cast("long").alias("pos"), "item")
    )


def _each(work):
    """A pandas function that does `work` for the arcs of every piece."""

    def run(arcs: pd.Series, totals: pd.Series) -> pd.Series:
        return pd.Series([work(a, t) for a, t in zip(arcs, totals, strict=True)])

    def rows(arcs: pd.Series, totals: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([work(a, t) for a, t in zip(arcs, totals, strict=True)], columns=["z", "p"])

    return rows if work is expected else run
