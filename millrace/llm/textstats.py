"""Statistics of a text that tell running prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from millrace.session import ship

#: Common words (fixed values): function words of English, German, French, Spanish and Italian.
COMMON = frozenset("""
the of and to in is that we a for by with as it are be this on which from not our has an at or have was were can its if when but then so all one no than been there these their they into only any each some may must whether
der die das und ist nicht mit von den des dem ein eine einer einem wir sich auf für wird dass daß nach bei aus wie im zu zur als auch noch ob sind man hat durch über nur sie
le la les et est que qui du une un pour dans nous par sur ne pas il se au aux ce cette dont si en avec sont de on encore bien après comment tous
el los las y es una con se no del para su como por lo esta este más al o sin todavía aunque sabe cuando según solo
il che di non per della è sono nel alla dei questo come anche si
""".split())

#: Names of the statistics, in order.
STATS = ("chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "other_script_ratio", "punctuated_lines", "common_words", "prose_share",
         "distinct_lines", "single_letters", "list_lines", "cells_per_line", "commands_per_word", "words_per_line", "reference_lines", "capital_lines",
         "math_share", "long_word_share", "message_lines", "sentence_ends")

_ALNUM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
_SPACE = b" \t\r\n\x0b\x0c"
_HIGH = bytes(range(128, 256))
_MATH = re.compile(r"\$[^$]*\$")
_DISPLAY = re.compile(r"\\begin\{(equation|align|gather|eqnarray|multline|displaymath|math)(\*?)\}.*?\\end\{\1\2\}|\\\[.*?\\\]", re.S)
_ITEM = re.compile(r"^\s*(?:\\item\b|[-*•]\s|\(?\d+[.)]\s|\\(?:input|include|subfile|contentsline|indexspace|subitem|newcommand|renewcommand|def|usepackage|ProvidesPackage|RequirePackage)\b)")
_REFERENCE = re.compile(r"\\bibitem|\\newblock|\b(?:1[89]|20)\d\d\b.*\d|\bpp?\.\s*\d|^\s*@\w+\{|^\s*(?:author|title|year|journal|pages|volume)\s*=")
_MESSAGE = re.compile(r"^(?:!|l\.\d+|\[\]|%!|%%|Overfull|Underfull|LaTeX |Package |\(\S+\.(?:sty|tex|cls))|input line \d|at lines \d")
#: A full stop or exclamation mark after a word, a bracket or a formula; initials do not end a sentence.
_END = re.compile(r"(?:\w\w|[)}\]x'\"»”])[.!][\"')}\]]*(?=\s|\Z)")
_NUMBERED = re.compile(r"^\s*\d\d+[.](?=\s)", re.M)
#: Words that one sentence covers at most, on average; text with fewer sentence ends is no running text.
SENTENCE_WORDS = 28
#: Below this share of common words the language counts as unknown.
UNKNOWN_LANGUAGE = 0.06
_HARD = re.compile(r"\\(?:begin|end|label|maketitle|tableofcontents|bibliography|bibliographystyle|appendix|noindent|newpage|clearpage|author|title|date|documentclass|usepackage|pagestyle|centering|hline|includegraphics|(?:sub)*section|chapter|paragraph|thanks|email|address|affiliation)\b")
_TAIL = re.compile(r"\\begin\{thebibliography\}|\\section\*?\{(?:References|Bibliography|Literatur|Références|Referencias|Bibliographie)\}|^(?:References|Bibliography|Literatur|Références|Referencias)\s*$", re.M)


def body_of(text: str) -> str:
    """The text without a markup preamble and without a closing bibliography that follows text."""
    at = text.find("\\begin{document}")
    body = text[at + 16:] if at >= 0 else text
    last = None
    for last in _TAIL.finditer(body):
        pass
    if last is not None:
        head = body[: last.start()]
        if sum(len(COMMON.intersection(x.split())) >= 2 for x in head.split("\n")) >= 2 and "\\section" not in body[last.end():]:
            body = head
    return body


def _share_any_language(text: str, content: float) -> float:
    """Share of running lines where no common word of a known language is found: lines of several words in lower-case
    letters, or of mostly letters in a script without spaces, and ends of sentences often enough."""
    good = ends = words = 0
    seen: set[str] = set()
    for x in text.split("\n"):
        w = x.split()
        k = len(w)
        if not w or x in seen or "&" in x or _MESSAGE.search(x) or x[0] == "\\" and _HARD.match(x):
            words += k
            continue
        seen.add(x)
        if k * 12 < len(x):  # a script without spaces
            letters = sum(c.isalpha() for c in x)
            words += len(x) // 2
            if letters >= 0.75 * len(x) and not x.isascii():
                good += len(x)
                ends += sum(x.count(c) for c in "。！？")
            continue
        words += k
        plain = [t.strip(".,;:!?()\"'«»„“”") for t in w]
        if k >= 5 and sum(t.isalpha() and len(t) > 1 for t in plain) >= 0.7 * k and sum(t[:1].islower() for t in plain) >= 0.5 * k:
            good += len(x)
            ends += len(_END.findall(x))
    return min(good / max(content, good, 1), SENTENCE_WORDS * ends / max(words, 1))


def text_stats(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, STATS in order; all 0 for null and blank texts. The whole text is read."""
    body = body_of(text or "")
    if not body.strip():
        return (0.0,) * len(STATS)
    raw = body.encode("utf-8", "replace")
    n = len(raw)
    dense = raw.translate(None, _SPACE)
    high = len(raw) - len(raw.translate(None, _HIGH))
    symbols = len(dense.translate(None, _ALNUM)) - high
    digits = n - len(raw.translate(None, b"0123456789"))
    plain = body
    if "\\begin{" in body or "\\[" in body:
        plain = _DISPLAY.sub(" ", plain)
    inline = _MATH.sub("x", plain) if "$" in plain else plain
    lines = [x for x in body.split("\n") if x and not x.isspace()]
    every = len(lines)
    punct = items = cells = refs = caps = messages = 0
    for x in lines:
        y = x.rstrip()
        punct += y[-1] in ".!?:;"
        c = y.lstrip()[0]
        caps += c.isupper()
        if c in "\\-*•(0123456789":
            items += _ITEM.match(y) is not None
        cells += y.count("&") + y.count("\t")
        refs += _REFERENCE.search(y) is not None if ("19" in y or "20" in y or "\\" in y or "=" in y or "p." in y) else 0
        messages += _MESSAGE.search(y) is not None if c in "!l[%OULP(" or "line" in y else 0
    words = total = common = single = long_ = good = frame = 0
    seen: set[str] = set()
    for x in inline.split("\n"):
        w = x.split()
        if not w:
            continue
        k = len(w)
        words += k
        hits = len(COMMON.intersection(w))
        common += hits
        total += len(x)
        short = sum(len(t) == 1 for t in w)
        single += short
        # a running line has several common words, is not letter-spaced and was not seen before
        if x[0] == "\\" and _HARD.match(x):
            frame += len(x)
        elif x[0] in "!l[%OULP(" and _MESSAGE.search(x):
            pass
        elif hits >= (2 if k > 6 else 1) and k >= 3 and short * 3 < k and x not in seen and "&" not in x:
            good += len(x)
        elif k >= 3 and k <= 6 and x not in seen and hits == 0 and short == 0 and x[-1:] in ".," and x.replace(" ", "").isalpha():
            good += len(x)
        seen.add(x)
        long_ += sum(len(t) > 30 for t in w)
    words = max(words, 1)
    math_chars = max(0, len(body) - len(inline))
    # headings and other frame count for nothing, formulas for less than half
    content = len(inline) - frame - inline.count("\n") + 0.4 * (len(body) - len(plain)) if plain is not body else len(inline) - frame - inline.count("\n")
    ends = len(_END.findall(inline)) - len(_NUMBERED.findall(inline))
    share = min(good / max(content, good, 1), SENTENCE_WORDS * ends / words)
    if common < UNKNOWN_LANGUAGE * words and share < 0.5:
        share = max(share, _share_any_language(inline, content))
    return (float(n), float(words), total / words, symbols / n, digits / n, high / n, punct / every, common / words, share,
            len(set(lines)) / every, single / words, items / every, cells / every, body.count("\\") / words, words / every, refs / every, caps / every,
            math_chars / max(len(body), 1), long_ / words, messages / every, ends / words)


_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[^\W\d_a-zß-ÿ]|[¿¡\\(\d]|\Z)")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
#: Votes of the labelers: prose at or above the first share, junk at or below the second, none between.
RUNNING, COVERED = (0.6, 0.3), (0.5, 0.1)
#: So many lines or more, this share of them of one shape that is no plain text, are a structure.
SHAPED_LINES, SHAPED_SHARE = 6, 0.6


def _covered(inline: str, display: int) -> float:
    """Share of the text in whole sentences: 4 to 60 words, for the most part in lower-case letters, not seen before.
    The characters of displayed formulas count for less than half, as prose may have many."""
    lines = [x for x in inline.split("\n") if x.strip() and not (x[0] == "\\" and _HARD.match(x))]
    text = " ".join(lines)
    good, seen = 0, set()
    for x in _SENTENCE.split(text):
        w = x.split()
        if 4 <= len(w) <= 60 and x not in seen and x.rstrip("\"')] ")[-1:] in ".!?" and "&" not in x:
            if sum(t.strip(".,;:!?()\"'«»„“”").isalpha() and t[:1].islower() for t in w) >= 0.55 * len(w):
                good += len(x)
        seen.add(x)
    return good / max(len(text) + 0.4 * display, 1)


def _shaped(body: str) -> bool:
    """Whether most lines begin in one and the same way that is not words: a macro, numbers and separators, a label."""
    shapes: dict[str, int] = {}
    n = 0
    for x in body.split("\n"):
        if not x.strip():
            continue
        n += 1
        first = [("w" if t.isalpha() else "0" if t.isdigit() else t) for t in _TOKEN.findall(x[:60])[:4]]
        if any(t != "w" and t not in ",.$" for t in first[:3]):
            key = "".join(first)
            shapes[key] = shapes.get(key, 0) + 1
    return n >= SHAPED_LINES and max(shapes.values(), default=0) >= SHAPED_SHARE * n


def weak_vote(text: str | None, stats: tuple[float, ...]) -> int:
    """1 for prose, -1 for structural junk, 0 if unknown: the sign of what three labelers say, each of which may abstain:
    the share of running lines, the share of the text in whole sentences, and the sameness of line beginnings.
    None of the three is a feature of the classifier."""
    body = body_of(text or "")
    if not body.strip():
        return 0
    plain = _DISPLAY.sub(" ", body) if "\\begin{" in body or "\\[" in body else body
    inline = _MATH.sub("x", plain) if "$" in plain else plain
    share, cover = stats[STATS.index("prose_share")], _covered(inline, len(body) - len(plain))
    votes = (share >= RUNNING[0]) - (share <= RUNNING[1])
    if inline.count(" ") * 12 >= len(inline):  # in a script without spaces sentences are not told by words
        votes += (cover >= COVERED[0]) - (cover <= COVERED[1])
    votes -= _shaped(body)
    return int(votes > 0) - int(votes < 0)


SCHEMA = ", ".join(f"{s} double" for s in STATS) + ", vote int"


def statistics(documents: DataFrame, voted: Column) -> DataFrame:
    """(doc_id, STATS..., vote) of every document; vote is null unless `voted`. One Arrow pass over the texts, no shuffle;
    repeated rows stay repeated."""

    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [text_stats(t) for t in rows["text"]]
            out = pd.DataFrame(got, columns=list(STATS), dtype="float64") if got else pd.DataFrame({s: pd.Series(dtype="float64") for s in STATS})
            out.insert(0, "doc_id", rows["doc_id"].to_numpy())
            out["vote"] = pd.array([weak_vote(t, s) if v else None for t, s, v in zip(rows["text"], got, rows["voted"])], dtype="Int32")
            yield out

    return documents.select("doc_id", "text", voted.alias("voted")).mapInPandas(run, "doc_id bigint, " + SCHEMA)
