"""Structured and full-text search over documents: the filter, its query language, and the plan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import fts
from foliant.sources.views import Archive

SORTABLE = ("title", "file_size", "created_at")
DEFAULT_LIMIT, MOST, PAGE = 50, 100, 25
# Units of sizes in queries.
UNITS = {"b": 1, "kb": 1024, "mb": 1048576, "gb": 1073741824}


@dataclass(frozen=True)
class Filter:
    query: str = ""
    tags: tuple[str, ...] = ()
    people: tuple[tuple[str, str], ...] = ()
    document_type: str = ""
    language: str = ""
    created: tuple[str | None, str | None] = (None, None)
    modified: tuple[str | None, str | None] = (None, None)
    size: tuple[int | None, int | None] = (None, None)
    missing_language: bool = False
    missing_type: bool = False
    untagged: bool = False
    sort_by: str = "created_at"
    sort_order: str = "desc"
    limit: int = PAGE
    offset: int = 0
    rank_order: str = "asc"  # full-text results come least relevant first, as the reference has it; desc is the option


def coerce(value: str | None, default: int, least: int = 0, most: int = 0) -> int:
    """A page parameter: out of range or unreadable becomes the default; a bound of 0 is none."""
    try:
        n = int(value) if value is not None else default
    except ValueError:
        return default
    return default if (least and n < least) or (most and n > most) else n


def clamp_limit(n: int) -> int:
    return DEFAULT_LIMIT if n <= 0 else min(n, MOST)


_FIELD = re.compile(r'(\w+):("[^"]*"|\[[^\]]*\]|\([^)]*\)|(?!["\s\])])\S+)')


def tokenize(text: str) -> list[tuple[str | None, str, str]]:
    """(field or None, value, as written) of each token of a query."""
    out, rest = [], text.strip()
    while rest:
        m = _FIELD.match(rest)
        if m:
            v = m[2]
            if len(v) > 1 and v[0] + v[-1] in ('""', "[]", "()"):
                v = v[1:-1]
            out.append((m[1], v, m[0]))
        else:
            m = re.match(r"\S+", rest)
            out.append((None, m[0], m[0]))
        rest = rest[m.end() :].lstrip()
    return out


def parse_dates(raw: str) -> tuple[str | None, str | None] | None:
    if m := re.fullmatch(r"([^.]*)\.\.(.+)", raw):
        return m[1] or None, m[2]
    if m := re.fullmatch(r"([<>])=?\s*(.+)", raw):
        return (m[2], None) if m[1] == ">" else (None, m[2])
    return (raw, None) if re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", raw) else None


def parse_size(raw: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"([<>]=?)?\s*(-?[\d.]+)\s*(kb|mb|gb|b)?", raw, re.I)
    try:
        return (m[1] or "", int(float(m[2]) * UNITS[(m[3] or "b").lower()] + 0.5)) if m else None
    except ValueError:
        return None


def parse_query(text: str, person_types: set[str] = frozenset()) -> Filter:
    """A search string as a filter; what is no field is free text."""
    f: dict = {"tags": [], "people": []}
    words: list[str] = []
    for name, v, raw in tokenize(text):
        if name == "tag":
            f["tags"].append(v)
        elif name in ("type", "lang"):
            f["document_type" if name == "type" else "language"] = v
        elif name in ("created", "modified") and (d := parse_dates(v)):
            f[name] = d
        elif name == "missing":
            key = {"lang": "missing_language", "type": "missing_type", "tags": "untagged"}.get(v)
            if key:
                f[key] = True
        elif name == "size" and (s := parse_size(v)):
            lo, hi = f.get("size", (None, None))
            op, n = s
            f["size"] = (n, n) if op == "" else (n, None if op == ">" else hi) if op[0] == ">" else (None if op == "<" else lo, n)
        elif name in person_types:
            f["people"].append((v, name))
        else:
            words.append(raw)
    return Filter(query=" ".join(words), **{k: tuple(v) for k, v in f.items() if k in ("tags", "people")}, **{k: v for k, v in f.items() if k not in ("tags", "people")})


def format_size(n: int) -> str:
    for unit in ("gb", "mb"):
        if n >= UNITS[unit]:
            return f"{n / UNITS[unit]:.1f}".removesuffix(".0") + unit.upper()
    return f"{n / 1024:.0f}KB" if n >= 1024 else f"{n}B"


def format_query(f: Filter) -> str:
    """The search string of a filter. Values with spaces are quoted, and a size range prints as two bounds, so that it reads back."""
    q = lambda v: f'"{v}"' if re.search(r"\s", v) else v
    out = [f.query] if f.query else []
    out += [f"tag:{q(t)}" for t in f.tags] + [f"{t}:{q(n)}" for n, t in f.people]
    out += [f"type:{q(f.document_type)}"] if f.document_type else []
    out += [f"lang:{q(f.language)}"] if f.language else []
    for name, (a, b) in (("created", f.created), ("modified", f.modified)):
        if a or b:
            out.append(f"{name}:{a}..{b}" if a and b else f"{name}:>{a}" if a else f"{name}:<{b}")
    out += [f"missing:{k}" for k, on in (("lang", f.missing_language), ("type", f.missing_type), ("tags", f.untagged)) if on]
    lo, hi = f.size
    if lo is not None and lo == hi:
        out.append(f"size:{format_size(lo)}")
    else:
        out += [f"size:>={format_size(lo)}"] if lo is not None else []
        out += [f"size:<={format_size(hi)}"] if hi is not None else []
    return " ".join(out)


def from_record(text: str) -> Filter:
    """The filter that a saved search holds as JSON; unknown keys are left out."""
    d = {k: v for k, v in (json.loads(text) or {}).items() if v is not None}
    f: dict = {k: d[k] for k in ("query", "document_type", "language", "sort_by", "sort_order", "limit", "offset", "missing_language", "missing_type", "untagged") if k in d}
    f |= {"tags": tuple(d["tags"])} if d.get("tags") else {}
    f |= {"people": tuple((p["name"], p["type"]) for p in d["people"])} if d.get("people") else {}
    for key, name, a, b in (("date_created", "created", "from", "to"), ("date_modified", "modified", "from", "to"), ("file_size", "size", "min", "max")):
        if key in d:
            f[name] = (d[key].get(a), d[key].get(b))
    return Filter(**f)


def to_record(f: Filter) -> str:
    """A filter as the JSON of a saved search, without what it does not say."""
    d: dict = {k: v for k in ("query", "document_type", "language", "missing_language", "missing_type", "untagged") if (v := getattr(f, k))}
    d |= {"tags": list(f.tags)} if f.tags else {}
    d |= {"people": [{"name": n, "type": t} for n, t in f.people]} if f.people else {}
    for key, pair, a, b in (("date_created", f.created, "from", "to"), ("date_modified", f.modified, "from", "to"), ("file_size", f.size, "min", "max")):
        if own := {k: v for k, v in ((a, pair[0]), (b, pair[1])) if v is not None}:
            d[key] = own
    return json.dumps(d | {"sort_by": f.sort_by, "sort_order": f.sort_order, "limit": f.limit, "offset": f.offset}, ensure_ascii=False)


def saved(searches: DataFrame, search_id: int) -> Filter:
    """The filter of a saved search."""
    row = searches.filter(F.col("id") == search_id).select("filter_json").first()
    if row is None:
        raise KeyError(search_id)
    return from_record(row.filter_json)


def _between(c: Column, lo: object, hi: object, to=lambda v: F.lit(v)) -> list[Column]:
    return ([c >= to(lo)] if lo is not None else []) + ([c <= to(hi)] if hi is not None else [])


def matching(a: Archive, f: Filter) -> DataFrame:
    """The live documents that the filter lets through; empty parts of it add nothing to the plan. Where the archive has an index, full-text search reads
    the query's lexemes there (and adds the rank); else it reads all texts."""
    df = a.live
    ts = lambda v: F.to_timestamp(F.lit(v))
    for p in _between(F.col("created_at"), *f.created, ts) + _between(F.col("modified_at"), *f.modified, ts) + _between(F.col("file_size"), *f.size):
        df = df.filter(p)
    if f.language:
        df = df.filter(F.col("language") == f.language)
    if f.missing_language:
        df = df.filter(F.col("language").isin("und", ""))
    if f.missing_type:
        df = df.filter(F.col("document_type_id") == 1)
    if f.document_type:
        kind = a.document_type.filter(F.col("name") == f.document_type).select(F.col("id").alias("document_type_id"))
        df = df.join(kind, "document_type_id", "left_semi")
    if f.tags:  # any of them
        t = a.document_tag.join(a.tag.filter(F.col("name").isin(*f.tags)).select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select(F.col("document_id").alias("id"))
        df = df.join(t, "id", "left_semi")
    for name, kind in f.people:  # all of them
        p = a.people.filter(F.col("name") == name).select(F.col("id").alias("people_id"))
        k = a.people_type.filter(F.col("name") == kind).select(F.col("id").alias("people_type_id"))
        df = df.join(a.document_people.join(p, "people_id", "left_semi").join(k, "people_type_id", "left_semi").select(F.col("document_id").alias("id")), "id", "left_semi")
    if f.untagged:
        df = df.join(a.document_tag.select(F.col("document_id").alias("id")), "id", "left_anti")
    if (q := f.query.strip()) and a.index:
        df = df.join(fts.hits(fts.read_index(a.spark, a.index), q), "id")
    elif q:
        df = df.filter(fts.matches(fts.index_text(F.col("title"), F.col("text_content")), q))
    return df


COLUMNS = ["id", "document_id", "title", "md5_checksum", "original_type", "file_size", "page_count", "word_count", "char_count", "language", "created_at", "modified_at", "document_type_id", "original_path", "storage_path"]


def search(a: Archive, f: Filter, snippets: bool = False) -> DataFrame:
    """One page of results. The text is read only where the query asks for it."""
    df = matching(a, f)
    q = f.query.strip()
    if q:
        if not a.index:
            df = df.withColumn("rank", fts.rank(fts.index_text(F.col("title"), F.col("text_content")), q))
        order = [F.col("rank").asc() if f.rank_order == "asc" else F.col("rank").desc(), F.col("id")]
    else:
        by = F.col(f.sort_by if f.sort_by in SORTABLE else "created_at")
        order = [by.asc_nulls_last() if f.sort_order.lower() == "asc" else by.desc_nulls_first(), F.col("id")]
    cols = [*COLUMNS, *(["rank"] if q else []), *(["text_content"] if snippets else [])]
    page = df.select(*cols).orderBy(*order).offset(max(0, f.offset)).limit(clamp_limit(f.limit))
    return page.withColumn("snippet", fts.snippet(q)("text_content")).drop("text_content") if snippets else page


def total(a: Archive, f: Filter) -> DataFrame:
    return matching(a, f).agg(F.count(F.lit(1)).alias("total"))


def with_labels(a: Archive, page: DataFrame) -> DataFrame:
    """A page with the names of its tags and its people: one join each instead of a lookup for each row."""
    ids = page.select("id")
    dt = a.document_tag.join(ids, F.col("document_id") == F.col("id"), "left_semi").join(a.tag.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    tags = dt.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    dp = a.document_people.join(ids, F.col("document_id") == F.col("id"), "left_semi").join(a.people.select(F.col("id").alias("people_id"), F.col("name").alias("person")), "people_id").join(a.people_type.select(F.col("id").alias("people_type_id"), F.col("name").alias("role")), "people_type_id")
    people = dp.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("person", "role"))).alias("people"))
    out = page.join(tags.withColumnRenamed("document_id", "id"), "id", "left").join(people.withColumnRenamed("document_id", "id"), "id", "left")
    return out.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>"))})


def first_page(f: Filter) -> Filter:
    return replace(f, offset=0)


def suggest(a: Archive, field: str, start: str) -> DataFrame:
    """Completions: tags and people by prefix, types by part, ten of a field; without a field and from two characters on, five tags, five people and all types that fit, ten in all."""
    pre = lambda df, kind, n: df.filter(F.col("name").startswith(start)).select(F.lit(kind).alias("field"), F.col("name").alias("value")).distinct().orderBy("value").limit(n)
    types = a.document_type.filter(F.contains(F.lower("name"), F.lit(start.lower()))).select(F.lit("type").alias("field"), F.col("name").alias("value")).distinct().orderBy("value").limit(10)
    if field == "tag":
        return pre(a.tag, "tag", 10)
    if field == "type":
        return types
    if field:
        return pre(a.people, field, 10)
    if len(start) < 2:
        return types.limit(0)
    return pre(a.tag, "tag", 5).unionByName(pre(a.people, "person", 5)).unionByName(types).limit(10)
