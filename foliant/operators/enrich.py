"""Enrichment of documents: tag filters, people, types, and the analysis stage, whose model is any callable."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import contains_non_latin, estimate_tokens_of, normalize_for_db
from foliant.functions.translit import transliterated
from foliant.operators import textrank
from foliant.operators.state import numbered
from foliant.schemas import PEOPLE_TYPES

MOST_TAGS, MOST_WORDS, TITLE = 5, 3, 127
HEAD, TAIL = 600, 400
# Least target of the second attempt, and how much under the limit it aims.
LEAST_RETRY, AIM = 100, 0.9


def filter_tags(tags: Column, people: Column, known: Column, title: Column, types: Column) -> Column:
    """The first five tags that say something: not over three words, no word of a person of the document or of a type name, not wholly in one known person's name (from two words on), not
    wholly in the title. All arguments are normalised; people, known and types are arrays of names."""
    tok = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    none = F.array().cast("array<string>")
    names = F.flatten(F.transform(F.coalesce(people, none), tok))
    kinds = F.flatten(F.transform(F.coalesce(types, none), tok))
    heading = tok(F.coalesce(title, F.lit("")))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0

    def keep(t: Column) -> Column:
        ws = tok(t)
        n = F.size(ws)
        someone = F.exists(F.coalesce(known, none), lambda k: within(ws, tok(k)))
        return n.between(1, MOST_WORDS) & ~F.arrays_overlap(ws, names) & ~((n >= 2) & someone) & ~F.arrays_overlap(ws, kinds) & ~within(ws, heading)

    return F.slice(F.filter(tags, keep), 1, MOST_TAGS)


def canonical_person(name: Column, romanised: Column) -> Column:
    """The name in Latin script: itself, or how it was romanised, or else transliterated."""
    other = contains_non_latin(name)
    return F.when(other & (F.coalesce(romanised, F.lit("")) != ""), romanised).when(other, transliterated(name)).otherwise(name)


def native_person(name: Column) -> Column:
    """The name as it was written, where that is in another script; else ''."""
    return F.when(contains_non_latin(name), name).otherwise("")


def upsert_people(people: DataFrame, found: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(people, links document_id, people_id, role). found: document_id, name, native (how the name was romanised is in `name`; null or '' if unknown), role.
    Persons are matched by the normalised name in Latin script (of a name that nothing is left of, by the name itself); new ones are added once, a missing
    native name is filled by the first one given, and a role that is no type of person is `unknown`."""
    f = found.withColumn("native", F.when(F.coalesce("native", F.lit("")) != "", F.col("native")).when(contains_non_latin(F.col("name")), F.col("name")))
    f = f.withColumn("name", canonical_person(F.col("name"), F.lit("")))
    key = normalize_for_db("name")
    f = f.withColumn("normalized_name", F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(F.lower(F.trim(F.coalesce("native", "name")))))
    held = people.filter("normalized_name <> ''").groupBy("normalized_name").agg(F.min("id").alias("person"))
    new = f.filter("normalized_name <> ''").groupBy("normalized_name").agg(F.min(F.struct("name", "native")).alias("x")).join(held, "normalized_name", "left_anti")
    add = numbered(new, ["normalized_name"], people).select("id", F.col("x.name").alias("name"), F.col("x.native").alias("name_native"), "normalized_name", at.alias("created_at"))
    natives = f.filter("native is not null").groupBy("normalized_name").agg(F.min("native").alias("_native"))
    filled = people.join(natives, "normalized_name", "left").withColumn("name_native", F.coalesce("name_native", "_native")).select(*people.columns)
    out = filled.unionByName(add.select(*people.columns))
    ids = out.filter("normalized_name <> ''").groupBy("normalized_name").agg(F.min("id").alias("people_id"))
    links = f.join(ids, "normalized_name").select("document_id", "people_id", F.when(F.col("role").isin(*PEOPLE_TYPES), F.col("role")).otherwise("unknown").alias("role")).distinct()
    return out, links


def resolve_type(df: DataFrame, types: DataFrame, name: str = "type") -> DataFrame:
    """df with document_type_id; an unknown name gets type 1."""
    t = types.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("_id"))
    return df.join(t, F.lower(name) == F.col("_name"), "left").withColumn("document_type_id", F.coalesce("_id", F.lit(1))).drop("_name", "_id")


# What a provider says when a text is too long.
TOKEN_LIMIT = r"maximum context length is (\d+) tokens.*?you requested (?:about )?(\d+) tokens"


def token_limit(body: Column) -> Column:
    """(most, requested) tokens that an error names; null if it names none or a zero."""
    most, asked = (F.regexp_extract(body, TOKEN_LIMIT, g).try_cast("int") for g in (1, 2))
    return F.when((most > 0) & (asked > 0), F.struct(most.alias("most"), asked.alias("requested")))


def error_class(body: Column, status: Column, provider: Column | None = None) -> Column:
    """credit (stop the batch): 402 and 429, and 400 with `arrearage` from the one provider that says so; tokens (text too long) or other."""
    owed = F.coalesce((F.lit("") if provider is None else provider) == "qwen", F.lit(False)) & (status == 400) & F.lower(body).contains("arrearage")
    return F.when(status.isin(402, 429) | owed, "credit").when(token_limit(body).isNotNull(), "tokens").otherwise("other")


def _answer_error(body: str, status: int, provider: str) -> tuple[str, int, int]:
    """`error_class` and `token_limit` of one answer of a model."""
    if status in (402, 429) or (provider == "qwen" and status == 400 and "arrearage" in body.lower()):
        return "credit", 0, 0
    m = re.search(TOKEN_LIMIT, body)
    most, asked = (int(m[1]), int(m[2])) if m else (0, 0)
    return ("tokens", most, asked) if most and asked else ("other", 0, 0)


class ModelError(Exception):
    """What a model callable raises when the provider refuses: the answer's body, status and provider."""

    def __init__(self, body: str, status: int, provider: str = ""):
        super().__init__(body)
        self.body, self.status, self.provider = body, status, provider


def retry_target(target: int, most: int, actual: int) -> int | None:
    """The word target of the second attempt, or None where it would be too small."""
    n = int(target * most / max(1, actual) * AIM)
    return n if n >= LEAST_RETRY else None


PROMPT = "Name the title, type, tags, people and language of this document as JSON.\nTypes: {types}\nTags so far: {tags}\n\n{text}"


def build_prompt(template: str, **values: str) -> str:
    """The template filled in; a template that does not fit the values falls back to the standard one."""
    try:
        return template.format(**values)
    except (KeyError, IndexError, ValueError):
        return PROMPT.format(**values)


def stub_model(prompt: str) -> str:
    """The stand-in model: the first words as title, the longest words as tags."""
    text = prompt.rsplit("\n\n", 1)[-1]
    ws = re.findall(r"[^\W\d_]{4,}", text)
    tags = sorted(dict.fromkeys(w.lower() for w in ws), key=lambda w: (-len(w), w))[:8]
    return json.dumps({"title": " ".join(text.split()[:8]), "type": "", "tags": tags, "people": [], "language": ""})


def http_model(url: str, model: str, api_key: str = "", provider: str = "", timeout: float = 120.0, temperature: float = 0.0) -> Callable[[str], str]:
    """A model behind an HTTP endpoint that takes chat messages as JSON and answers with choices; what it refuses becomes a ModelError."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as r:
                answer = json.loads(r.read())
        except urllib.error.HTTPError as x:
            raise ModelError(x.read().decode("utf-8", "replace"), x.code, provider) from x
        except (urllib.error.URLError, ValueError, TimeoutError) as x:
            raise ModelError(str(x), 0, provider) from x
        return answer["choices"][0]["message"]["content"] if answer.get("choices") else ""

    return ask


def analyze(df: DataFrame, key: str, text: str, model: Callable[[str], str] = stub_model, template: str = PROMPT, types: str = "", tags: str = "", most_tokens: int = 0) -> DataFrame:
    """key, title, type, tags, language, attempts, error: the model's answer for each text. An empty or unreadable answer is asked for once more. A text that is
    too long (over most_tokens by estimate, or by the model's own word, a ModelError) is reduced to the words that fit and asked for once more;
    errors: `credit` (the batch is to be paused: pause_batches), `too large`, `empty`, or what the model said."""

    def ask(prompt: str) -> dict:
        raw = model(prompt)
        raw = re.sub(r"^\s*```(?:json)?|```\s*$", "", raw).strip()
        try:
            answer = json.loads(raw)
        except ValueError:
            return {}
        return answer if isinstance(answer, dict) else {}

    def one(t: str) -> tuple[dict, int, str | None]:
        target, tried, again = len(t.split()), 0, True
        while True:
            prompt, tried = build_prompt(template, types=types, tags=tags, text=t), tried + 1
            try:
                if most_tokens and (n := estimate_tokens_of(prompt)) > most_tokens:
                    kind, most, asked = "tokens", most_tokens, n
                else:
                    answer = ask(prompt)
                    if any(answer.get(k) for k in ("title", "type", "tags", "people", "language")):
                        return answer, tried, None
                    if not again:
                        return answer, tried, "empty"
                    again = False
                    continue
            except ModelError as x:
                kind, most, asked = _answer_error(x.body, x.status, x.provider)
                if kind == "other":
                    return {}, tried, x.body or "failed"
            if kind == "credit":
                return {}, tried, "credit"
            words = retry_target(target, most, asked)
            if tried > 1 or words is None:
                return {}, tried, "too large"
            t = textrank.reduce_text(t, words)
            target = words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b.key, b.text):
                answer, tried, error = one(t or "")
                rows.append((k, answer.get("title"), answer.get("type"), [x for x in answer.get("tags") or [] if isinstance(x, str)], answer.get("language"), tried, error))
            yield pd.DataFrame(rows, columns=["key", "title", "type", "tags", "language", "attempts", "error"])

    kt = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kt}, title string, type string, tags array<string>, language string, attempts int, error string")
    return out.withColumnRenamed("key", key)
