"""Variant spellings of the names of persons and organisations.

Each name is read into a kind (person or organisation), its distinctive words (family or house names, given names), initials and line of
business; titles, legal forms, branch notes, case, accents and the order of the parts fall away, nicknames stand for the full
name. Names that read the same are one record from there on.

Blocking: the last and the first MIN_SUFFIX letters of every distinct word (its suffix, and that of the reversed word) index the vocabulary,
as do the word with a letter or two left out and, of a long word, any three letters in a row, so that no single slip keeps two words apart;
words that meet are alike if the ratio of their longest common subsequence says so. Each word of a record must be like
a word of the one it fits, so a record is compared with all that have a word like its rarest one. No block is cut: one of more than
BLOCK rows is dealt to sub-blocks that are joined one by one, and pairs that cannot fit are dropped before the full comparison.

Links join full names first; their connected components are the entities. A name that has only an initial (or no line of business)
joins an entity if it is the only one that it fits. Components come from label propagation over shuffled tables, each round
written to the shared folder. All joins are merge joins: a table that looks small once compressed would be broadcast, and several of them at once
are more than a driver holds.

Defined results: null, empty and unreadable names stay alone; rows of one id count once (the first by name); same readings are linked also if the
name is short; a person and an organisation of one name are different; a native name only supports a link or, if both natives are full and differ, bars it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import in_batches
from foliant.session import stored

MIN_SUFFIX, BLOCK = 5, 2000
FAMILY_RATIO, GIVEN_RATIO = 0.8, 0.79

# Nicknames and forms of given names, a group a line.
NICKNAMES = """
margaret maggie peggy meg marge margot greta
elizabeth beth liz betty eliza lisa lizzie elisabeth
william bill will billy liam willem wilhelm guillermo
robert bob rob bobby roberto bert
richard rick dick richie ricardo
charles chas charlie chuck carlos karl
dorothea dora dot dorothy thea
henrietta hettie etta harriet henny
katharina kathi kate katrin catherine kathy katja kat
johannes hans jan hannes johann joao
sebastian basti seb bastian
francisco paco pancho franz frank
ignacio nacho ignatius ignaz
josefina pepa josie fina josephine
giuseppe beppe pino peppe josef
nicolaas klaas nico niklas nick nicholas nikolaus
guillaume guy gui
dimitra demetra mimi dimi
spyros spiros spyridon spiro
panagiota giota panayota yota
yannis ioannis giannis yiannis
eleni helen lena heleni nelly
svetlana sveta swetlana lana
yekaterina ekaterina katya katerina
mikhail misha michail michael mike
dmitri dima dmitry dimitrij mitya
vladimir volodya vova wladimir
tatyana tanya tatiana tania
aleksei alexei alyosha alexey lyosha
pavel pasha pawel paul
grigori grisha grigory gregory greg
theodore ted teddy theo fedor
olivia livvy liv ollie
yolanda yoli iolanda jolanda
xavier javier xavi javi
quentin quintin quinn
zacharias zach zacharius zack
leopold leo poldi
lawrence larry laurence lars
ulrich uli ulli
matthias matze mathias matt mats
annemarie anne annie anna
patricia pat trish patty tricia
victoria vicky vicki tori viktoria
bernadette berni bernie detta
ernesto erni ernest ernst
"""
_NICK = {n: line.split()[0] for line in NICKNAMES.strip().splitlines() for n in line.split()}
# Words that say nothing about whose name it is; legal forms; lines of business with their stems.
TITLES = set("dr prof rev ing phd esq mr mrs ms sir dipl med jun jr sr mag the retired hq head office accounts account dept department branch sons son and und y et co company".split())
LEGAL = {"ltd", "limited", "inc", "incorporated", "ag", "aktiengesellschaft", "gmbh", "bv", "sa", "plc", "llc", "corp", "corporation", "kg", "nv", "srl", "spa", "oy", "ab"}
LINES = "insurance pharma pharmaceuticals bakery bakeries maschinenbau electrical engineering engineers consulting consultants consultancy logistics publishing publishers textiles construction transport foods media software trading energy motors chemicals steel shipping bank holding brewery printing".split()
_SAME_LINE = {"pharma": "pharmaceuticals", "bakeries": "bakery", "consultants": "consulting", "consultancy": "consulting", "engineers": "engineering", "publishers": "publishing"}

_LETTERS = re.compile(r"[^\W\d_]+\.?")


# Greek and Cyrillic letters in Latin script, pairs of letters first.
GREEK = "αι:ai ει:ei οι:oi ου:u αυ:av ευ:ev μπ:b ντ:d γκ:g γγ:ng θ:th χ:ch ψ:ps ξ:x α:a β:v γ:g δ:d ε:e ζ:z η:i ι:i κ:k λ:l μ:m ν:n ο:o π:p ρ:r σ:s ς:s τ:t υ:y φ:f ω:o"
CYRILLIC = "ье:ye ья:ya ж:zh х:kh ц:ts ч:ch ш:sh щ:shch ю:yu я:ya а:a б:b в:v г:g д:d е:e ё:e з:z и:i й:y к:k л:l м:m н:n о:o п:p р:r с:s т:t у:u ф:f ъ: ы:y ь: э:e"
_LATIN = dict(x.split(":") for x in f"{GREEK} {CYRILLIC}".split())
_FOREIGN = re.compile("|".join(sorted(_LATIN, key=len, reverse=True)))


def fold(s: str) -> str:
    """s without accents; Greek and Cyrillic letters in Latin script."""
    if s.isascii():
        return s
    s = unicodedata.normalize("NFC", s)
    s = "".join(c if "\u0400" <= c <= "\u04ff" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in s)
    if re.search("[\u0370-\u04ff]", s):
        s = re.sub(r"\w+", lambda m: _FOREIGN.sub(lambda x: _LATIN[x[0]], m[0].lower()).title() if re.search("[\u0370-\u04ff]", m[0]) else m[0], s)
    return s


def lcs_ratio(a: str, b: str) -> float:
    """2 LCS / (len a + len b), by bit-parallel steps."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def line_of(word: str, dotted: bool) -> str | None:
    """The line of business a word names, also cut off or misspelt."""
    w = word.rstrip(".")
    for line in LINES:
        if w == line or (len(w) >= 3 and dotted and line.startswith(w)) or (len(w) >= 4 and line.startswith(w) and len(w) >= len(line) // 2) or (len(w) >= 6 and lcs_ratio(w, line) >= 0.82):
            return _SAME_LINE.get(line, line)
    return None


def read_name(name: str | None) -> tuple[str, tuple[str, ...], tuple[str, ...], str]:
    """(kind p or o or '', distinctive words sorted, initials in order, line of business) of a name."""
    if not name:
        return "", (), (), ""
    s = re.sub(r"\([^)]*\)", " ", fold(name))
    s = re.sub(r"\s[-–]\s.*$", " ", s)
    s = re.sub(r",\s*(?:head office|accounts? dep\w*\.?|branch.*|esq\.?|hq|ph\.?\s?d\.?)\s*$", " ", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])(?=[A-Z](?:[a-z]|\.))|(?<=\.)(?=[^\W\d_]{2})", " ", s)
    s = re.sub(r"\bph\.\s?d\b\.?", " ", s, flags=re.I)
    s = re.sub(r"\bmasch(?:inen|\.)?[-\s]?bau\b", " maschinenbau ", s, flags=re.I)
    # Letters with full stops side by side are one legal form, if they spell one and the rest has a line of business.
    def joined(m: re.Match) -> str:
        j = re.sub(r"\W", "", m[0]).lower()
        return f" {j} " if j in LEGAL else m[0]

    s = re.sub(r"(?<![^\W\d_])(?:[^\W\d_]\.\s?){2,4}(?![^\W\d_])", joined, s)
    words, initials, lines, legal = [], [], [], False
    for m in _LETTERS.finditer(s):
        t = m[0].lower()
        w = t.rstrip(".")
        if (w in TITLES and t != "y.") or (w == "s" and m.start() and s[m.start() - 1] in "'’"):
            continue
        if w in LEGAL:
            legal = True
        elif len(w) == 1 or (t[-1] == "." and len(w) <= 6 and line_of(t, True) is None):
            initials.append(w)  # a letter, or a given name cut off or contracted, as in Joh. and Wm.
        elif (line := line_of(t, t.endswith("."))) is not None:
            lines.append(line)
        else:
            words.append(w)
    for i in range(len(words) - 1, 0, -1):  # a given name in two parts
        if words[i - 1] + words[i] in _NICK:
            words[i - 1 : i + 1] = [words[i - 1] + words[i]]
    if not words:
        return "", (), tuple(initials), ""
    if lines or legal:
        return "o", tuple(sorted(words)), (), min(lines, default="")
    return "p", tuple(sorted(_NICK.get(w, w) for w in words)), tuple(initials), ""


def native_key(native: str | None) -> str:
    """The words of a native name in fixed order; '' where it is empty or has an initial."""
    ws = re.findall(r"[^\W\d_]+", fold(native or "").casefold())
    return " ".join(sorted(ws)) if len(ws) > 1 and all(len(w) > 1 for w in ws) else ""


def fits(a: tuple, b: tuple) -> int:
    """How two readings (kind, words, initials, line, native) fit: 2 the same full name, 1 as far as one of them goes, 0 not."""
    ka, wa, ia, la, na = a
    kb, wb, ib, lb, nb = b
    if ka != kb or not wa or not wb:
        return 0
    if ka == "o":
        if not _match(wa, wb, FAMILY_RATIO) or len(wa) != len(wb):
            return 0
        return 2 if la and la == lb else 1 if not la or not lb else 0
    if na and nb and na != nb and lcs_ratio(na, nb) < FAMILY_RATIO:
        return 0
    if len(wa) > len(wb):
        return fits(b, a)
    if len(wa) == len(wb):
        if len(wa) > 1:
            ok = _match(wa, wb, GIVEN_RATIO)
            if not ok:
                return 0
            return 0 if ia and ib and not set(ia) & set(ib) else 2
        if "".join(wa) == "".join(wb):
            return 2 if ia == ib else 1
        if lcs_ratio(wa[0], wb[0]) < FAMILY_RATIO:
            return 0
        if not ia or not ib:
            return 1 if not ia and not ib and not min(len(wa[0]), len(wb[0])) < 8 else 0
        return (2 if ia == ib else 1) if ia[0] == ib[0] else 0
    # One has a word more: the words left over are given names that the initials of the other stand for, or run together with it.
    joined = lcs_ratio("".join(sorted(wa)), "".join(wb))
    if len(wa) == 1 and len(wa[0]) >= 12 and max(lcs_ratio(wa[0], "".join(wb)), lcs_ratio(wa[0], "".join(reversed(wb))), joined) >= 0.92:
        return 2
    left = list(wb)
    for w in wa:
        best = max(left, key=lambda x: lcs_ratio(w, x))
        if lcs_ratio(w, best) < FAMILY_RATIO:
            return 0
        left.remove(best)
    if not ia:
        return 0
    first = ia[:1] if len(left) == 1 else ia  # further initials are middle names
    return 1 if left and all(any(_stands(i, x) for i in first) for x in left) and (not ib or set(ib) & set(ia) or len(ia) == 1) else 0


_FORMS: dict[str, list[str]] = {}
for _n, _full in _NICK.items():
    _FORMS.setdefault(_full, []).append(_n)


def _stands(initial: str, word: str) -> bool:
    """Can the initial or contraction stand for the given name (a contraction also for its other forms)?"""
    if len(initial) == 1:
        return word[0] == initial
    return any(f[0] == initial[0] and lcs_ratio(initial, f) == 2 * len(initial) / (len(initial) + len(f)) for f in _FORMS.get(word, [word]))


def _match(wa: tuple[str, ...], wb: tuple[str, ...], least: float) -> bool:
    """Do the words pair off one to one, each pair with at least that ratio?"""
    left = list(wb)
    for w in sorted(wa, key=len, reverse=True):
        if not left:
            return False
        best = max(left, key=lambda x: lcs_ratio(w, x))
        r = lcs_ratio(w, best)
        if r < (least if min(len(w), len(best)) > 4 else 0.85):
            return False
        left.remove(best)
    return len(wa) <= len(wb)


_PARSED = "id long, kind string, words array<string>, initials array<string>, line string, native string, legal boolean"
#: Besides the words of LINES, one that stands in names with a legal form beside so many different words is a line of business.
HOUSES = 3


def readings(people: DataFrame, key: str, name: str, native: str) -> DataFrame:
    df = people.select(F.col(key).cast("long").alias("id"), F.col(name).alias("name"), F.col(native).alias("native"))
    df = df.groupBy("id").agg(F.min(F.struct("name", "native")).alias("x")).select("id", "x.*")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, n, nat in zip(b.id, b.name, b.native):
            k, w, ini, line = read_name(n if isinstance(n, str) else None)
            legal = k == "o" and any(x in LEGAL for x in re.findall(r"[^\W\d_]+", n.lower().replace(".", "")))
            rows.append((i, k, list(w), list(ini), line, native_key(nat if isinstance(nat, str) else None), legal))
        return pd.DataFrame(rows, columns=["id", "kind", "words", "initials", "line", "native", "legal"])

    return _organisations(stored(in_batches(df, run, _PARSED), "parsed"))


def _organisations(rows: DataFrame) -> DataFrame:
    """The readings with lines of business as the table has them, and with names without a legal form taken for the organisation that has one."""
    given = F.array(*[F.lit(w) for w in sorted(_NICK)])
    firm = rows.filter("kind = 'o' and size(words) > 1")
    word = firm.filter("legal").select(F.explode("words").alias("w"), F.array_join("words", " ").alias("all")).filter(~F.array_contains(given, F.col("w")))
    lines = word.groupBy("w").agg(F.count_distinct("all").alias("n")).filter(F.col("n") >= HOUSES).select("w")
    hits = rows.filter("size(words) > 1").select("id", F.explode("words").alias("w")).join(lines.hint("merge"), "w").groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("own"))
    # A name of the same two words or more as one with a legal form, if none of them is a given name.
    plain = rows.filter("kind = 'p' and size(words) > 1 and size(initials) = 0").select("id", F.array_join("words", " ").alias("all")).filter(~F.arrays_overlap(F.split("all", " "), given))
    same = plain.join(firm.filter("legal and line = ''").select(F.array_join("words", " ").alias("all")).distinct().hint("merge"), "all", "left_semi").select("id", F.lit(True).alias("same"))
    both = rows.join(hits.hint("merge"), "id", "left").join(same.hint("merge"), "id", "left")
    rest = F.array_except("words", "own")
    turns = F.col("own").isNotNull() & (F.size(rest) > 0) & (F.size("initials") == 0) & (F.col("line") == "")
    firmly = turns | F.coalesce("same", F.lit(False))
    return both.select(
        "id", F.when(firmly, F.lit("o")).otherwise(F.col("kind")).alias("kind"), F.when(turns, rest).otherwise(F.col("words")).alias("words"), "initials",
        F.when(turns, F.col("own")[0]).otherwise(F.col("line")).alias("line"), "native",
    )


def _keys(word: str, near: bool = False) -> set[str]:
    """The keys under which a word meets the words that are like it: any two one slip apart (a letter changed, added, left out or two swapped)
    share one. Unless only near ones are asked for, longer words also meet at two slips (7 to 12 letters) or by any three letters in a row (from 13)."""
    n, e = MIN_SUFFIX, len(word)
    out = {"=" + word} | ({">" + word[-n:], "<" + word[:n]} if e >= n else set())
    less = {word[:i] + word[i + 1 :] for i in range(e)} if e > 2 else set()
    if not near and 7 <= e <= 12:
        less |= {x[:i] + x[i + 1 :] for x in less for i in range(len(x))}
    if not near and e >= 13:
        out |= {"*" + word[i : i + 3] for i in range(e - 2)}
    return out | {"=" + x for x in less}


def _salted(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left and right joined; the rows of right that share a value are dealt to sub-blocks of about BLOCK rows, each of which meets all of left."""
    n = right.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("salts")).hint("merge")
    l = left.join(n, on).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    r = right.join(n, on).withColumn("salt", F.pmod(F.xxhash64(*right.columns), F.col("salts")).cast("int")).drop("salts")
    return l.join(r.hint("merge"), [on, "salt"]).drop("salt")


def _near(w: str | Column, v: str | Column) -> Column:
    """False only for words under GIVEN_RATIO: the edit distance is at most the number of letters outside the common subsequence."""
    return F.levenshtein(w, v) <= F.lit(1 - GIVEN_RATIO + 1e-9) * (F.length(w) + F.length(v))


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """w, v (both ways): the pairs of words whose ratio is at least that; equal words are alike."""
    pairs = pairs.dropDuplicates()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return p[[lcs_ratio(w, v) >= least for w, v in zip(p.w, p.v)]]

    return in_batches(pairs, run, "w string, v string")


def _keyed(words: DataFrame, near: bool = False) -> DataFrame:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(w, k) for w in b.w for k in sorted(_keys(w, near))]
        return pd.DataFrame(rows, columns=["w", "k"])

    return in_batches(words, run, "w string, k string")


def candidates(recs: DataFrame) -> DataFrame:
    """a, b: the records that are compared, a < b."""
    own = recs.select("sig", "kind", F.array_distinct("words").alias("words"), "initials").withColumn("size", F.size("words"))
    word = stored(own.select("sig", "kind", "size", F.explode("words").alias("w")), "words")
    vocabulary = word.select("w").distinct()
    keys = stored(_keyed(vocabulary), "keys")
    met = _salted(keys, keys.withColumnRenamed("w", "v"), "k").filter("w < v").filter(_near("w", "v")).select("w", "v")
    like = _alike(met, GIVEN_RATIO)
    like = stored(like.unionByName(like.select(F.col("v").alias("w"), F.col("w").alias("v"))).unionByName(vocabulary.select("w", F.col("w").alias("v"))), "alike")
    # Of two records that fit, each word of the one with fewer words is like a word of the other: its rarest one is looked up.
    count = like.join(word.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("n")).hint("merge"), "v").groupBy("w").agg(F.sum("n").alias("n"))
    rarest = word.join(count.hint("merge"), "w").groupBy("sig").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    ask = rarest.join(like.hint("merge"), "w").select("v", F.col("sig").alias("a"))
    both = _salted(ask, word.select(F.col("w").alias("v"), F.col("sig").alias("b")).dropDuplicates(), "v").filter("a <> b").select("a", "b")
    side = lambda s: own.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "words", "initials", "size")]).hint("merge")
    both = both.dropDuplicates().join(side("a"), "a").join(side("b"), "b")
    letters = F.transform("initials_a", lambda i: F.substring(i, 1, 1))
    # What no pair that fits lacks: the other words alike; for a given name left over, an initial that may stand for it.
    stands = F.exists("initials_a", lambda i: F.length(i) > 1) | F.exists("words_b", lambda x: F.array_contains(letters, F.substring(x, 1, 1)))
    both = both.filter("kind_a = kind_b and size_a <= size_b and (kind_a = 'p' or size_a = size_b)").filter((F.col("size_a") == F.col("size_b")) | stands)
    both = both.filter(F.forall("words_a", lambda x: F.exists("words_b", lambda y: _near(x, y)))).select("a", "b")
    # A name in one word may be another's words run together.
    persons = own.filter("kind = 'p'")
    single = persons.filter("size = 1").select("sig", F.col("words")[0].alias("w")).filter(F.length("w") >= 12)
    runs = F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), ""))
    joined = persons.filter("size > 1").select("sig", F.explode(runs).alias("w")).filter(F.length("w") >= 10)
    k1, k2 = _keyed(single.select("w").distinct(), True), _keyed(joined.select("w").distinct(), True).withColumnRenamed("w", "v")
    met = _alike(_salted(k1, k2, "k").filter(_near("w", "v")).select("w", "v"), 0.92)
    run_on = met.join(single.select("w", F.col("sig").alias("a")).hint("merge"), "w").join(joined.select(F.col("w").alias("v"), F.col("sig").alias("b")).hint("merge"), "v").select("a", "b")
    both = both.unionByName(run_on)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").dropDuplicates()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp: the least node of each node's connected component, by label propagation; rounds go through the shared folder."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).dropDuplicates(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("comp")), "labels")  # only nodes with edges take part
    while True:
        got = both.join(labels.hint("merge"), both["y"] == labels["node"]).groupBy("x").agg(F.min("comp").alias("least"))
        new = labels.join(got.hint("merge"), labels["node"] == got["x"]).select("node", F.least("comp", "least").alias("comp"), F.col("comp").alias("old"))
        jump = new.select(F.col("node").alias("c"), F.col("comp").alias("to"))
        new = stored(new.join(jump.hint("merge"), F.col("comp") == F.col("c")).select("node", F.least("comp", "to").alias("comp"), "old"), "labels")
        labels = new.select("node", "comp")
        if new.filter("comp <> old").limit(1).count() == 0:
            break
    return nodes.select("node").join(labels.hint("merge"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def entities(people: DataFrame, key: str = "id", name: str = "name", native: str = "name_native") -> DataFrame:
    """key, entity (its least id): one row a person or organisation row."""
    sig_cols = ["kind", "words", "initials", "line", "native"]
    rows = stored(readings(people, key, name, native), "readings")
    alone = rows.filter("kind = ''").select("id", F.col("id").alias("entity"))
    named = rows.filter("kind <> ''")
    recs = stored(named.groupBy(sig_cols).agg(F.min("id").alias("sig")), "records")
    pairs = candidates(recs)
    side = lambda s: recs.select(F.col("sig").alias(s), F.struct(*sig_cols).alias(f"r{s}")).hint("merge")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    flat = pairs.select("a", "b", *[F.col(f"r{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in sig_cols])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        get = lambda s: zip(p[f"kind_{s}"], map(tuple, p[f"words_{s}"]), map(tuple, p[f"initials_{s}"]), p[f"line_{s}"], p[f"native_{s}"])
        return pd.DataFrame({"a": p.a, "b": p.b, "fit": [fits(x, y) for x, y in zip(get("a"), get("b"))]})

    edges = stored(in_batches(flat, run, "a long, b long, fit int").filter("fit > 0"), "links")
    nodes = recs.select(F.col("sig").alias("node"))
    full = components(edges.filter("fit = 2"), nodes)
    # A name that goes only part of the way joins the one entity it fits.
    part = recs.filter("(kind = 'o' and line = '') or (kind = 'p' and size(words) = 1)").select(F.col("sig").alias("node"))
    weak = edges.filter("fit = 1")
    weak = weak.select("a", "b").unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = nodes.join(part.hint("merge"), "node", "left_anti").withColumnRenamed("node", "b")
    asks = weak.join(part.withColumnRenamed("node", "a").hint("merge"), "a", "left_semi").join(whole.hint("merge"), "b", "left_semi")
    labelled = asks.join(full.select(F.col("node").alias("b"), F.col("comp").alias("to")).hint("merge"), "b").join(full.select(F.col("node").alias("a"), F.col("comp").alias("own")).hint("merge"), "a")
    only = labelled.groupBy("own").agg(F.min("to").alias("to"), F.max("to").alias("to2")).filter("to = to2").select(F.col("own").alias("a"), F.col("to").alias("b"))
    left = part.join(labelled.select(F.col("a").alias("node")).distinct().hint("merge"), "node", "left_anti")
    among = weak.filter("a < b").join(left.withColumnRenamed("node", "a").hint("merge"), "a", "left_semi").join(left.withColumnRenamed("node", "b").hint("merge"), "b", "left_semi")
    strong = edges.filter("fit = 2").select("a", "b")
    final = components(strong.unionByName(only).unionByName(among), nodes)
    back = named.join(recs.hint("merge"), [named[c].eqNullSafe(recs[c]) for c in sig_cols]).select(named["id"], "sig")
    member = back.join(final.hint("merge"), F.col("sig") == F.col("node")).select("id", F.col("comp").alias("entity"))
    return member.unionByName(alone).withColumnRenamed("id", key)


def same_pairs(people: DataFrame, key: str = "id", name: str = "name", native: str = "name_native") -> DataFrame:
    """id_a < id_b: all pairs of ids of one entity. Entities of one row give none."""
    e = stored(entities(people, key, name, native).withColumnRenamed(key, "id"), "entities")
    a, b = e.select("entity", F.col("id").alias("id_a")), e.select("entity", F.col("id").alias("id_b"))
    return a.join(b.hint("merge"), "entity").filter("id_a < id_b").select("id_a", "id_b")
