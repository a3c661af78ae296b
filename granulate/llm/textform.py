"""Per-document text statistics and the form of a text, worked out line by line."""

from __future__ import annotations

import re
from collections import Counter

# Frequent function words by language.
COMMON = {
    "en": "the of and a in to is was were with for that by on it be as at from are this which not or an",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an wir war",
    "fr": "le la les de des et à en un une du que qui dans est pour par sur au avec ne pas ont il été",
    "es": "el la los las de y en que se un una del por con no es para al lo como su más fue a o",
    "nl": "de het een en van in is dat op te met voor niet zijn er aan om ook door bij als was werd uit naar",
    "it": "il la di e che in un una per è del della con non sono da le gli i al si nel come dei più",
    "pt": "o a os as de e que em um uma do da para com não por se no na mais dos das foi ao é",
}
LANGS = {k: frozenset(v.split()) for k, v in COMMON.items()}
SPOKEN = {w: [k for k in LANGS if w in LANGS[k]] for v in LANGS.values() for w in v}
# Words of page furniture.
FURNITURE = frozenset(
    "menu home search login log in sign up register subscribe share cite download pdf print next previous figure back to top view all show more "
    "related items terms privacy policy accept cookies contact about help follow us read skip content navigation sitemap close open "
    "copyright rights reserved newsletter loading click here settings account cart".split()
)

WORD = re.compile(r"[^\W\d_]+")
BULLET = re.compile(r"^\s*(?:[-*•–▪◦+]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\]|\[\d+\])\s+\S")
KEYED = re.compile(r"^\s*[^\s:=][^:=]{0,40}?\s*(?:[:=]|->|→)\s*\S.{0,80}$")
BORDER = re.compile(r"^[\s|+:=\-_]{3,}$")
CODE = re.compile(r"0x[0-9a-fA-F]{4,}|\b(?:DBG|ERR|TRC|WARN|INFO|DEBUG|ERROR|TRACE)\b|^\s*at [\w.$]+\(|\b[0-9a-fA-F]{16,}\b")
CELL = re.compile(r"^\W*(?:[-+]?\d[\d.,]*\s*\S{0,4}|n/?a|-|–|)\W*$", re.I)
MOJIBAKE = re.compile(r"[ÃÂâ][\u0080-¿€™œž¤©°±²³´µ¶·¸¹º»¼½¾¿£¥§¨ª«¬®¯]|ï»¿|�")
SENTENCE = re.compile(r"[.!?…][\"”»')\]]*(?:\s|$)")
BREAK = re.compile(r"\r\n|[\n\r\f\v\u2028\u2029]")
MARK = re.compile(r"[^\w\s]|_")
DIGIT = re.compile(r"\d")
CLOSED = re.compile(r"[.!?…:;][\"”»')\]]*$")
VOWEL = re.compile("[aeiouyäöüàáâãåæèéêëìíîïòóôõøùúûýœ]")
TORN = re.compile(r"[^\W\d_][^\w\s'’\-–./,:()&;·][^\W\d_]")


def spoken(words: list[str]) -> Counter:
    """How many of the words are function words, by language."""
    hits: Counter = Counter()
    for w, n in Counter(words).items():
        for k in SPOKEN.get(w, ()):
            hits[k] += n
    return hits


def common_share(hits: Counter, n: int) -> float:
    """Largest share of one language's function words among `n` words."""
    return max(hits.values()) / n if hits else 0.0


def _delimited(line: str) -> tuple[str, int] | None:
    """The column mark of a line and how many columns it makes."""
    t = line.strip()
    if t.startswith("<t") or "</td>" in t or "</th>" in t:
        return "html", 0
    if t.startswith("{") and t.rstrip(",").endswith("}"):
        return "json", t.count(":")
    for mark in ("\t", "|", "&", ";"):
        if t.count(mark) >= (2 if mark == ";" else 1) or mark == "\t" and mark in line:
            return mark, line.count(mark)
    if len(re.findall(r"\S {2,}\S", t)) >= 2 or len(re.findall(r" {2,}", t)) >= 2:
        return "  ", 0
    if t.count(",") >= 2:
        return ",", t.count(",")
    return None


def _tables(lines: list[str]) -> list[bool]:
    """Which lines are records: neighbours with the same mark and as many columns, mostly short cells."""
    marks = [_delimited(x) for x in lines]
    out = [False] * len(lines)
    i = 0
    while i < len(lines):
        if marks[i] is None:
            i += 1
            continue
        j = i
        while j < len(lines) and (marks[j] is not None and marks[j] == marks[i] or BORDER.match(lines[j]) and lines[j].strip()):
            j += 1
        run = [k for k in range(i, j) if not BORDER.match(lines[k])]
        mark = marks[i][0]
        if len(run) >= 3 or mark in ("html", "json") and run:
            cells = [c for k in run for c in (re.split(r" {2,}", lines[k].strip()) if mark == "  " else lines[k].split(mark if len(mark) == 1 else None))]
            figures = sum(len(c) <= 40 and bool(CELL.match(c)) for c in cells) / max(1, len(cells))
            if mark in ("html", "json", "\t", "|", "&", "  ") or figures >= 0.4:
                for k in range(i, j):
                    out[k] = True
        i = max(j, i + 1)
    return out


def _leader(line: str) -> bool:
    """An entry of a table of contents: dots up to a page number."""
    bare = line.rstrip("0123456789")
    return bare != line and bare.rstrip().endswith(("....", ". . . .", "……"))


def _junk_line(line: str, words: list[str], share: float) -> bool:
    t = line.strip()
    n = max(1, len(t))
    if CODE.search(t) and share < 0.15:
        return True
    if len(MOJIBAKE.findall(t)) * 12 > n:
        return True
    if n >= 20 and sum(map(len, words)) < 0.6 * n and len(MARK.findall(t)) > 0.3 * n:
        return True
    if n > 40 and (longest := max(map(len, t.split()))) > 40 and longest > 0.5 * n and not t.startswith(("http", "www")):
        return True
    if n >= 20 and len(TORN.findall(t)) * 25 > n:
        return True
    if words and sum(w in FURNITURE for w in words) >= 0.8 * len(words):
        return True
    if len(words) >= 6:
        if share < 0.05 and sum(len(w) > 3 and len(VOWEL.findall(w)) < 0.2 * len(w) for w in words) > 0.25 * len(words):
            return True
        if len(set(words)) <= 0.25 * len(words) and len(words) >= 12:
            return True
    return False


def lines_by_form(lines: list[str], parsed: list[list[str]], shares: list[float]) -> dict[str, int]:
    """Characters of the text in prose, list, table and junk lines; `parsed` holds the words of each, `shares` those of function words."""
    out = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    table = _tables(lines)
    kinds: list[str] = []
    for i, (line, words, share) in enumerate(zip(lines, parsed, shares, strict=True)):
        t = line.strip()
        if table[i]:
            kind = "table"
        elif _leader(t):
            kind = "list"
        elif _junk_line(line, words, share):
            kind = "junk"
        elif BULLET.match(line) or KEYED.match(line) and share < 0.2:
            kind = "list"
        elif share >= 0.12 and (len(words) >= 5 or SENTENCE.search(t)):
            kind = "prose"
        elif len(words) >= 12 and share < 0.1 and t.count(",") + t.count(";") + t.count("|") + t.count(" / ") >= len(words) / 6:
            kind = "list"
        elif len(words) >= 15 and share < 0.06 and not SENTENCE.search(t[:-1]) and t.count(",") < len(words) / 12:
            kind = "junk"
        elif len(words) <= 8 and len(t) <= 70:
            kind = "short"
        elif share >= 0.08 or SENTENCE.search(t):
            kind = "prose"
        else:
            kind = "list" if t.count(",") + t.count(";") >= 3 else "prose"
        kinds.append(kind)
    # Short lines take the side of their neighbours: entries stand together, wrapped prose ends in them.
    for i, kind in enumerate(kinds):
        if kind == "short":
            a = next((kinds[k] for k in range(i - 1, -1, -1) if kinds[k] != "short"), None)
            b = next((kinds[k] for k in range(i + 1, len(kinds)) if kinds[k] != "short"), None)
            run = sum(1 for k in range(max(0, i - 2), min(len(kinds), i + 3)) if kinds[k] in ("short", "list"))
            kind = "prose" if (shares[i] >= 0.12 or SENTENCE.search(lines[i].strip())) and "prose" in (a, b) else "list" if run >= 3 else ("prose" if "prose" in (a, b) else b or a or "list")
        out[kind] += len(lines[i].strip())
    return out


def form_of(by: dict[str, int]) -> str:
    """prose, list, table or junk: what most characters of a text belong to; junk if there are none."""
    total = sum(by.values())
    if not total:
        return "junk"
    if by["prose"] * 2 >= total:
        return "prose"
    return other_form(by)


def other_form(by: dict[str, int]) -> str:
    """The form, other than prose, of most characters; junk if there are none."""
    best = max(("table", "list", "junk"), key=lambda k: by[k])
    return best if by[best] else "junk"


def statistics(text: str) -> dict[str, float | str]:
    """Figures of a text, the form of most of its lines, and the form it has if it is not prose; every figure of an empty text is 0."""
    raw = [x for x in BREAK.split(text) if x.strip()]
    parsed = [[w.lower() for w in WORD.findall(x)] for x in raw]
    hits = [spoken(words) for words in parsed]
    words = [w for x in parsed for w in x]
    n, chars = max(1, len(text)), max(1, sum(map(len, raw)))
    by = lines_by_form(raw, parsed, [common_share(h, len(w)) for h, w in zip(hits, parsed, strict=True)])
    return {
        "words": float(len(words)),
        "mean_word": sum(map(len, words)) / max(1, len(words)),
        "symbols": len(MARK.findall(text)) / n,
        "digits": len(DIGIT.findall(text)) / n,
        "closed_lines": sum(bool(CLOSED.search(x.strip())) for x in raw) / max(1, len(raw)),
        "common": common_share(spoken(words), len(words)),
        "distinct": len(set(words)) / max(1, len(words)) ** 0.8,
        "sentence_words": len(words) / max(1, len(SENTENCE.findall(text))),
        "marked": sum(len(x) for x in raw if BULLET.match(x)) / chars,
        "form": form_of(by),
        "other": other_form(by),
    }
