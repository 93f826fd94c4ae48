"""Texts cut off by field limits.

One pass over all texts runs a stack automaton (brackets, quotes, elements, escapes) to the end of each text, classifies its tail, and counts
for every word how often it stands anywhere, at the end of a sentence or line, in list items and at their end. From these tables:

- a tail with a broken character, escape or tag, or a bracket, quote or element that is left open is cut;
- a terminator ends a complete text; after an ellipsis or an abbreviation the last word and the limits decide;
- running text without a terminator is cut, measured against its source: where such texts are common and end as sentences end, it is
  the source's habit, and the last word decides;
- the end of a list, table, signature, reference or heading needs no terminator; it is complete if its last word often ends
  lines, sentences or items in the corpus (in a signature: if the word is known), and cut if it never does: a part of a word, or a word that has to go on;
- the limits of a source are the lengths (characters or bytes) at which its unterminated texts pile up, compared with their neighbourhood.

Word counts are reduced in each batch before they are shuffled; the tails meet the words in a join of two shuffled
tables, so no part of either is held by one task. All decisions rest on rates, not on counts that grow with the corpus.

Defined results: a null, empty or blank text is complete; a null source is a source of its own; rows of one id count once and are cut if one of them is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import stored

#: A last word ends lines this often, as a share of its occurrences, or it has to go on.
STOP_SHARE = 0.12
#: A source leaves terminators out by habit if so many of its texts that end in running text lack one, and so many of these end in words that end sentences.
HABIT, NATURAL = 0.2, 0.5
#: Unterminated texts of one length, at least, and against the mean of the lengths around it, that make it a limit.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_SPAN = 4, 6.0, 64

# Marks that say a text goes on elsewhere; abbreviations that a number or name follows.
MARKS = r"(?:\[\s*(?:\.\.\.|…|more|mehr|cut|snip|truncated|continued|gekürzt|suite|tronqué|continua|cortado|vervolg)\s*\]|\((?:\.\.\.|…|more|truncated|continued|cont\.?)\)?|<\s*(?:truncated|cut|more)\s*>|(?:read|see) more|>>+|-->)"
ABBREVIATIONS = {"no", "nr", "núm", "num", "n", "p", "pp", "vgl", "art", "dr", "st", "fig", "approx", "bzw", "ca", "resp"}

_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"\b([^\W_]++)[)\]\"”»’']*+(?:[.!?;:]|[ \t]*+\r?\n)")
_ITEM = re.compile(r"(?m)^[ \t]*(?:[-*•–]|\d{1,3}[.)])[ \t]+([^\n]*)\n")
_STRUCT = re.compile(r"[()\[\]{}«»“”„\"]|</?[A-Za-z][^<>\s]{0,40}(?:\s[^<>]*)?>|<(?=[A-Za-z/])|\n[ \t\r]*\n|\f")
_CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_BROKEN = re.compile(r"(?:�+|&#?[A-Za-z0-9]{1,8}|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|%[0-9A-Fa-f]?|=[0-9A-F]?)$")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?>")
_END_TAG = re.compile(r"</[A-Za-z][A-Za-z0-9]*\s*>$")
# Elements that need no end tag.
OPTIONAL = set("p li dt dd td th tr thead tbody tfoot option colgroup body html head br hr img input meta link area base col embed source track wbr".split())
_NAME = re.compile(r"(?:[^\W\d_a-zà-ÿ][\w’'-]*\.?)(?: [^\W\d_a-zà-ÿ][\w’'-]*\.?){1,3}")
_MARKED = re.compile(rf"\s*{MARKS}\s*$", re.I)
_TERMINATOR = re.compile(r"[.!?。！？][)\]\"”»’'*_]*$")
_ENDS = re.compile(r"(?:(?<=[^\W_])|(?<=[)\]\"”»%]))(?:[.!?]|:(?=\s*\n))[)\]\"”»’']*(?=\s+(?:[^\W\d_a-zà-ÿ]|[-*•–(\[¿¡\"“«„\d])|\s*\n)")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)]|[a-z]\))\s+\S")
_RULED = re.compile(r"^[\s\W_]*$")
_NUMBERS = re.compile(r"^\S{0,24}(?:\s+\S{1,12})?\s*[\t ]\s*[-+]?\d[\d.,]*\s*\S{0,3}$|^\s*[-+]?\d[\d.,/ ]*$")
_REFERENCE = re.compile(r"(?:^|\s)\S{1,16}\s*\d{1,6}[/-]\d{1,6}$")
_WRAPPED = re.compile(r"^[(\[][^()\[\]]{1,60}[)\]]$")


def open_ends(text: str) -> bool:
    """The stack automaton over the whole text: does its last sentence end inside a bracket, a quote or a tag?"""
    stack: list[str] = []
    where: list[int] = []
    for m in _STRUCT.finditer(text):
        x = m[0]
        if x[0] in "\n\f":
            stack.clear()  # a paragraph ends what it opened
            where.clear()
        elif x in "([{«“„<":
            stack.append(x)
            where.append(m.end())
        elif x == '"':
            if '"' in stack:
                del where[stack.index('"') :], stack[stack.index('"') :]
            else:
                stack.append(x)
                where.append(m.end())
        elif x in _CLOSES:
            opener = _CLOSES[x]
            if opener not in stack and x == "”" and "„" in stack:
                opener = "„"
            if opener in stack:
                i = len(stack) - 1 - stack[::-1].index(opener)
                del stack[i:], where[i:]
            elif x == "“":
                stack.append(x)
                where.append(m.end())
    return bool(stack) and not _ENDS.search(text, where[-1]) or "</" in text and open_elements(text)


def open_elements(text: str) -> bool:
    """Is an element left open that needs an end tag?"""
    stack: list[str] = []
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name in OPTIONAL or m[0].endswith("/>"):
            continue
        if not m[1]:
            stack.append(name)
        elif name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name) :]
    return bool(stack)


def last_word(t: str) -> str:
    j = len(t)
    while j and not t[j - 1].isalnum():
        j -= 1
    i = j
    while i and t[i - 1].isalnum():
        i -= 1
    return t[i:j].lower()


def last_end(t: str) -> int:
    """Where the last sentence that ends begins to be over, or 0; looked for further and further back."""
    size = 2000
    while True:
        start, at = max(0, len(t) - size), 0
        for m in _ENDS.finditer(t, start):
            if t[m.end() :].strip() and not (re.search(r"[^\W_]+$", t[max(0, m.start() - 12) : m.start()]) or [""])[0].lower() in ABBREVIATIONS:
                at = m.end()
        if at or not start:
            return at
        size *= 8


def tail(text: str | None) -> tuple[str, str]:
    """`ending` in fewer states: open is cut, name is word."""
    state, last = ending(text)
    return {"open": "cut", "name": "word"}.get(state, state), last


def ending(text: str | None) -> tuple[str, str]:
    """(state, last word): complete; cut; open (running text without a terminator: its source decides); word, item or name (its last word decides); sure (an
    ellipsis: its last word or a limit decides); dot (a limit decides). Marks and broken escapes have less than 60 characters."""
    if not text or not (t := text.rstrip()):
        return "complete", ""
    marked = _MARKED.search(t, max(0, len(t) - 60))
    if marked:
        before = t[: marked.start()].rstrip()
        return ("complete" if _TERMINATOR.search(before) and not before.endswith("...") else "cut"), ""
    tag = t.rfind("<")
    if _BROKEN.search(t[-60:]) and not t.endswith(("%", "=")) or t[-1] == "�" or (tag >= 0 and t.find(">", tag) < 0 and re.match(r"[A-Za-z/]", t[tag + 1 : tag + 2])):
        return "cut", ""
    last = last_word(t)
    if open_ends(t):
        return "cut", last
    if t[-1] == ">" and _END_TAG.search(t, t.rfind("<")):
        return "complete", last
    if t.endswith(("…", "...")):
        if t.rstrip(".…")[-1:] in tuple(")]”»"):
            return "complete", last
        return "sure", last
    if _TERMINATOR.search(t):
        if t.endswith(".") and last in ABBREVIATIONS and len(last) < 4:
            return "dot", last
        return "complete", last
    at = last_end(t)
    inline = at > 0 and "\n" not in t[at : at + len(t[at:]) - len(t[at:].lstrip())]
    rest = t[at:].strip()
    lines = [x.strip() for x in rest.split("\n") if x.strip()]
    end = lines[-1]
    if _RULED.match(end) or _WRAPPED.match(end):
        return "complete", last
    if _REFERENCE.search(end) and len(end) < 40:
        return "complete", last
    if _NUMBERS.match(end):
        shape = lambda x: re.sub(r"\d+", "0", x.split()[-1])
        rows = [x for x in lines[:-1] if _NUMBERS.match(x)]
        return ("cut" if rows and len({shape(x) for x in rows}) == 1 and shape(end) != shape(rows[0]) or rows and _decimals(rows[-1]) > _decimals(end) else "complete"), last
    if t[-1] in ",;:-–—(/&" and not _BULLET.match(end):
        return "cut", last
    if _BULLET.match(end):
        return "item", last
    if len(lines) > 1 and _NAME.fullmatch(end):
        return "name", last  # a signature
    paragraph = re.split(r"\n[ \t\r]*\n|\f", rest)[-1]
    ws = paragraph.split()
    if len(lines) > 1 and len(end.split()) <= 4 and len(lines[-2].split()) <= 7:
        return "word", last  # closing and signature, form, heading
    if len(ws) <= 6 and not (inline and len(lines) == 1) and (ws[0][:1].isupper() or ws[0][:1].isdigit()):
        return "word", last  # a short line of its own
    return "open", last


def _decimals(row: str) -> int:
    m = re.search(r"[.,](\d*)$", row)
    return len(m[1]) if m else 0


_SCHEMA = "kind int, id long, source string, chars long, bytes long, copy long, state string, word string, n long, stops long, items long, listed long"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        total, stops, items, listed, rows = Counter(), Counter(), Counter(), Counter(), []
        for i, s, copy, t in zip(b.id, b.source, b.copy_, b.text):
            t = t if isinstance(t, str) else ""
            state, word = ending(t)
            rows.append((0, i, s, len(t), len(t.encode("utf-8", "replace")), copy, state, "0" if word.isdigit() else word, 0, 0, 0, 0))
            low = t.lower()
            ws = _WORD.findall(low)
            total.update(ws)
            stops.update(_STOP.findall(low))
            for line in _ITEM.findall(low):
                if own := _WORD.findall(line):
                    listed.update(own)
                    items[own[-1]] += 1
            if ws:
                total[ws[-1]] -= 1  # the last word may be a part of one
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
        for c in (total, stops, items, listed):  # numbers count as one word
            digits = [w for w in c if w.isdigit()]
            c["0"] = sum(c.pop(w) for w in digits)
        ws = [w for w, n in total.items() if n > 0]
        if ws:
            yield pd.DataFrame({"kind": 1, "id": 0, "source": None, "chars": 0, "bytes": 0, "copy": 0, "state": None, "word": ws, "n": [total[w] for w in ws], "stops": [stops[w] for w in ws], "items": [items[w] for w in ws], "listed": [listed[w] for w in ws]})


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, cut (boolean), limit (the length its source cuts at, if the text has it): one row a key."""
    df = docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("copy_"), F.col(text).alias("text"))
    both = stored(df.mapInPandas(_scan, _SCHEMA), "tails")
    words = both.filter("kind = 1").groupBy("word").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"), F.sum("items").alias("items"), F.sum("listed").alias("listed"))
    tails = both.filter("kind = 0").select("id", "source", "chars", "bytes", "copy", "state", "word")
    # Lengths at which a source's texts that end in the middle of a sentence pile up; copies of one text count once.
    sizes = tails.filter("state in ('cut', 'open')").select("source", "copy", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x")).select("source", "copy", "x.*")
    at = sizes.dropDuplicates(["source", "unit", "size", "copy"]).groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("texts"))
    near = [F.struct((F.floor(F.col("size") / LIMIT_SPAN) + d).alias("cell"), F.when(F.lit(d == 0), F.col("size")).alias("own")) for d in (-1, 0, 1)]
    around = at.select("source", "unit", "texts", F.explode(F.array(*near)).alias("x")).groupBy("source", "unit", "x.cell").agg(F.sum("texts").alias("around"))
    limits = at.filter(F.col("texts") >= LIMIT_TEXTS).withColumn("cell", F.floor(F.col("size") / LIMIT_SPAN))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["unit"] == b["unit"]) & (a["cell"] == b["cell"])
    limits = limits.join(around, same(limits, around)).filter((F.col("texts") - 1) > LIMIT_TIMES * (F.col("around") - F.col("texts")) / (3 * LIMIT_SPAN - 1)).select(limits["source"].alias("s"), limits["unit"].alias("u"), limits["size"].alias("limit"))
    chars, lens = limits.filter("u = 'chars'").drop("u"), limits.filter("u = 'bytes'").drop("u").withColumnsRenamed({"s": "s2", "limit": "limit2"})
    asked = tails.filter("state in ('word', 'item', 'name', 'sure', 'dot', 'open')").join(words, "word", "left")
    asked = asked.join(chars, asked["source"].eqNullSafe(chars["s"]) & (asked["chars"] == chars["limit"]), "left").join(lens, asked["source"].eqNullSafe(lens["s2"]) & (asked["bytes"] == lens["limit2"]), "left")
    share = F.coalesce(F.col("stops") / F.col("n"), F.lit(0.0))
    limit = F.coalesce("limit", "limit2")
    in_items = F.coalesce(F.try_divide("items", "listed"), F.lit(0.0))
    natural = share >= STOP_SHARE
    # The habit of each source: a small table.
    prose = tails.groupBy("source").agg(F.sum((F.col("state") == "open").cast("long")).alias("open"), F.sum((F.col("state") == "complete").cast("long")).alias("whole"))
    ends = asked.filter("state = 'open'").groupBy(F.col("source").alias("s3")).agg(F.avg(natural.cast("double")).alias("natural"))
    habit = prose.join(ends, F.col("source").eqNullSafe(F.col("s3"))).filter((F.col("open") >= HABIT * (F.col("open") + F.col("whole"))) & (F.col("natural") >= NATURAL)).select("s3", F.lit(True).alias("habit"))
    asked = asked.join(habit, asked["source"].eqNullSafe(habit["s3"]), "left")
    state = F.col("state")
    cut = F.when(state == "dot", limit.isNotNull()).when(state == "sure", ~natural | limit.isNotNull()).when(state == "item", ~natural & (in_items < STOP_SHARE))
    cut = cut.when(state == "name", F.coalesce("n", F.lit(0)) == 0).when(state == "open", F.col("habit").isNull() | ~natural).otherwise(~natural)
    done = tails.filter("state in ('complete', 'cut')").select("id", "source", (F.col("state") == "cut").alias("cut"), F.lit(None).cast("long").alias("limit"))
    out = done.unionByName(asked.select("id", "source", cut.alias("cut"), limit.alias("limit")))
    return out.groupBy("id").agg(F.min("source").alias("source"), F.max("cut").alias("cut"), F.max("limit").alias("limit")).withColumnRenamed("id", key)


def rates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """source, documents, cut, rate."""
    n, c = F.count(F.lit(1)), F.coalesce(F.sum(F.col("cut").cast("long")), F.lit(0))
    return truncated(docs, key, text, source).groupBy("source").agg(n.alias("documents"), c.alias("cut"), F.round(c / n, 6).alias("rate"))
