"""Operator 2: licence scan over a positional index of rare words.

The index holds, for each passage of a licence's wording (a template), its words of highest inverse document frequency over
the template library, with their positions. A file's words are looked up in it; each posting gives the
place where the template would begin. Places that enough of a template's rare words agree on, give or
take SLACK words that a file inserts or leaves out, are its candidate alignments, and an alignment counts
only if all key phrases of the template stand in it. The base phrases are templates too, whose key phrase
is the whole phrase in its exact place.

Everything happens inside the row: postings are intersected by sorting (template, place) and comparing
each with the one `need - 1` further on. Only where those are near are the postings between counted, each
posting and each word of the file once. Nothing is shuffled.

Cost. A word is looked up by its hash in a table of slots, and what a template asks for by the template's
number, so a file's cost grows with its own hits and not with the size of the library.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.llm.license_texts import PASSAGES
from hopscale.llm.text import free, let, whole

OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, SHARE, SLACK = 12, 0.6, 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


#: Fixed phrases of the base rules.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)

_MARKED = re.compile(r"\{\{(.*?)\}\}", re.S)


def template(label: str, passage: str) -> Template:
    """A passage whose key phrases are marked with double braces."""
    return Template(label, _MARKED.sub(r"\1", passage), tuple(_MARKED.findall(passage)))


LIBRARY = tuple(template(*x) for x in PASSAGES)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def _index(templates: tuple[Template, ...]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings of the rare words: word -> (template, position); and how many postings must agree for each template."""
    docs = [_words(t.text) for t in templates]
    df = Counter(w for d in docs for w in set(d))
    postings: dict[str, list[tuple[int, int]]] = {}
    need = []
    for n, (t, d) in enumerate(zip(templates, docs, strict=True)):
        idf = {w: math.log(len(docs) / df[w]) for w in d}
        rare = sorted(set(d), key=lambda w: (-idf[w], d.index(w)))[: 2 if t.base else RARE]
        at = [(w, p) for p, w in enumerate(d) if w in rare]
        for w, p in at:
            postings.setdefault(w, []).append((n, p))
        need.append(len(at) if t.base else max(1, math.ceil(SHARE * len(at))))
    return postings, need


def lower_ascii(c: Column) -> Column:
    """Lower case that no character outside ASCII can turn into an ASCII letter; such characters stay parts of words."""
    # U+212A and U+0130 are the only ones whose lower case begins with an ASCII letter
    return F.lower(F.replace(F.replace(c, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def scan(docs: DataFrame, *, text: str = "text", templates: tuple[Template, ...] = LIBRARY, base: tuple[Template, ...] = BASE) -> DataFrame:
    """All rows and columns of docs with a struct column `_license`.

    n_words; places: array of (label, word, score, base, template), the verified alignments with the word
    where each begins, whole texts, all places, of each passage of a notice; base_labels and labels: sorted distinct arrays; score: the
    largest share of a template's rare words that agree on a verified place, 0 without any. A null text is empty:
    no words, no places. Templates must be in ASCII. Repeated rows are judged alike. All
    columns stay; if docs has a column `_license`, the new one has one more underscore, and so on; it is the last.
    """
    every = (*base, *templates)
    postings, need = _index(every)
    slots: list[list[str]] = [[] for _ in range(1 << (2 * len(postings)).bit_length())]
    for w in postings:
        slots[xxhash.xxh64_intdigest(w.encode(), 42) % len(slots)].append(w)
    # constants as one literal each, which Spark folds, instead of thousands of expressions
    const = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")
    index = const([[{"w": w, "ps": [{"t": t, "p": p} for t, p in postings[w]]} for w in slot] for slot in slots], "array<struct<w:string,ps:array<struct<t:int,p:int>>>>")
    looked_up = lambda w: F.get(F.filter(F.get(index, F.xxhash64(w).bitwiseAND(F.lit(len(slots) - 1)).cast("int")), lambda x: x["w"] == w), F.lit(0))["ps"]
    need_of = const(need, "int")
    total_of = const([float(sum(t == n for ps in postings.values() for t, _ in ps)) for n in range(len(every))], "double")
    sizes = [len(_words(t.text)) for t in every]
    keys = [tuple(" ".join(_words(k)) for k in t.keys) or (" ".join(_words(t.text)),) for t in every]
    keys_of = const([[f" {k} " for k in ks] for ks in keys], "array<string>")

    words = F.array_remove(F.split(lower_ascii(whole(text)), OTHER, -1), "")
    rare = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*postings), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    hits = lambda found: F.array_sort(F.flatten(F.transform(found, lambda x: F.transform(looked_up(x["w"]), lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("at"), q["p"].alias("p"))))))

    slack_of = const([0 if t.base else SLACK for t in every], "int")

    def window(h: Column, i: Column) -> Column:
        """Hits from i on that agree with hit i within the template's slack; h is sorted, so they follow one another."""
        # of one place a template has as many hits as postings at most
        most = (F.get(slack_of, F.get(h, i)["t"]) + 1) * F.get(total_of, F.get(h, i)["t"]).cast("int")
        return let(F.get(h, i), lambda c: F.filter(F.slice(h, i + 1, most), lambda x: (x["t"] == c["t"]) & (x["at"] <= c["at"] + F.get(slack_of, c["t"]))))

    def place(own: Column) -> Column:
        """The place that most hits name (the first of those), and how many postings agree: each posting and each word of the file counts once."""
        times = lambda x: F.size(F.filter(own, lambda y: y["at"] == x["at"]))
        at = -F.array_max(F.transform(own, lambda x: F.struct(times(x).alias("n"), (-x["at"]).alias("at"))))["at"]
        n = F.least(F.size(F.array_distinct(F.transform(own, lambda x: x["p"]))), F.size(F.array_distinct(F.transform(own, lambda x: x["at"] + x["p"]))))
        return F.struct(F.get(own, F.lit(0))["t"].alias("t"), at.alias("at"), n.alias("n"))

    def agreed(h: Column) -> Column:
        """Candidate places: enough postings agree on them within the slack. Of one template, places within the slack of the one before are the same."""

        def far(i: Column) -> Column:
            a, z = F.get(h, i), F.get(h, i + F.get(need_of, F.get(h, i)["t"]) - 1)
            return (a["t"] == z["t"]) & (z["at"] - a["at"] <= F.get(slack_of, a["t"]))

        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), far)
        found = F.filter(F.transform(starts, lambda i: let(window(h, i), place)), lambda c: c["n"] >= F.get(need_of, c["t"]))
        return F.array_sort(F.array_distinct(found))

    def apart(good: Column) -> Column:
        """Of a template's places within the slack of one another, that with most agreement, of those the first."""
        near = lambda x, c: (x["t"] == c["t"]) & (F.abs(x["at"] - c["at"]) <= F.get(slack_of, c["t"]))
        best = F.array_sort(F.transform(good, lambda c: F.struct((-c["n"]).alias("m"), c["t"].alias("t"), c["at"].alias("at"), c["n"].alias("n"))))
        kept = F.aggregate(best, F.filter(best, lambda c: F.lit(False)), lambda seen, c: F.when(F.exists(seen, lambda x: near(x, c)), seen).otherwise(F.array_append(seen, c)))
        return F.array_sort(F.transform(kept, lambda c: F.struct(c["t"].alias("t"), c["at"].alias("at"), c["n"].alias("n"))))

    def verified(w: Column, c: Column) -> Column:
        n, slack = F.get(const(sizes, "int"), c["t"]), F.get(slack_of, c["t"])
        start = F.greatest(c["at"] - slack, F.lit(0))
        span = F.concat(F.lit(" "), F.array_join(F.slice(w, start + 1, F.greatest(c["at"] + n + slack - start, F.lit(0))), " "), F.lit(" "))

        return ((slack > 0) | (c["at"] >= 0)) & let(span, lambda here: F.forall(F.get(keys_of, c["t"]), lambda k: F.contains(here, k)))

    def places(w: Column, h: Column) -> Column:
        share = lambda c: F.least(F.lit(1.0), c["n"] / F.get(total_of, c["t"]))
        good = let(F.filter(agreed(h), lambda c: verified(w, c)), apart)
        return F.transform(good, lambda c: F.struct(F.get(const([t.label for t in every], "string"), c["t"]).alias("label"), c["at"].alias("word"), share(c).alias("score"), F.get(const([t.base for t in every], "boolean"), c["t"]).alias("base"), c["t"].alias("template")))

    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), words.alias("_w"))
    d = d.withColumn("_rare", rare)
    none = F.array().cast("array<struct<label:string,word:int,score:double,base:boolean,template:int>>")
    found = let(F.col("_w"), lambda w: let(hits(F.col("_rare")), lambda h: places(w, h)))
    d = d.withColumn("_places", F.when(F.size("_rare") > 0, found).otherwise(none))
    labels = lambda xs: F.array_sort(F.array_distinct(F.transform(xs, lambda p: p["label"])))
    only = F.filter("_places", lambda p: p["base"])
    out = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.col("_places").alias("places"),
        labels(only).alias("base_labels"),
        labels(F.col("_places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
    return d.select("_row.*", out.alias(free("_license", docs)))
