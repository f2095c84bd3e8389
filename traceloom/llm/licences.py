"""Licence statements in texts by a positional index of rare words (operator 5), in DataFrame functions only.

A template is a run of words with a mandatory key phrase at its start. Document frequencies of all template words are
counted over the corpus; each template is indexed by its ``ANCHORS`` rarest words with their positions. A text's words
are looked up there, postings that agree on where the template would start are intersected, and the words at
that place are compared with the template: its key phrase must stand there word for word, and ``LEAST`` of all its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHORS = 2
LEAST = 0.8
#: Bytes between words of a text whose letters A-Z have not been lower-cased yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str = ""  # mandatory words at the start; empty: all words
    base: bool = False

    @property
    def run(self) -> list[str]:
        return self.words.split()

    @property
    def key_words(self) -> list[str]:
        return (self.key or self.words).split()


# Usual wordings of licence statements; fixed values.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
)


def literal(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Texts (of ``words``: an array) that hold each word; one row per vocabulary word reaches the driver."""
    held = words.select(F.explode(F.array_intersect("words", F.expr(literal(vocabulary)))).alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r[0]: r[1] for r in held.groupBy("word").agg(F.count("*")).collect()}


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def licence_labels(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = ANCHORS, least: float = LEAST
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs`` (doc_id, text).

    ``n_base`` counts the places where a base template stands, ``first_word`` and ``last_word`` are the smallest and
    largest start among them (words from 0, null without any). Labels are distinct, sorted and joined by
    commas; ``score`` is the largest share of a template's words found in place, 0 without any. Null and empty texts have no
    words; repeated rows are rows of their own; other columns are ignored. Nothing is shuffled but word counts.
    """
    vocabulary = sorted({w for t in templates for w in t.run})
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = document_frequencies(docs.select(F.split(F.lower("text"), SEPARATORS).alias("words")), vocabulary)
    postings: dict[str, list[tuple[int, int, int]]] = {}
    rarest = []
    for number, template in enumerate(templates):
        # The rarest words have the highest inverse document frequency; of equals the first.
        order = sorted(range(len(template.key_words)), key=lambda i: (count[template.run[i]], i))[:anchors]
        rarest.append(template.run[order[0]])
        for rank in range(anchors):
            i = order[min(rank, len(order) - 1)]  # a template of fewer words votes with its last one again
            postings.setdefault(template.run[i], []).append((rank, number, i))
    entries = {
        w: ", ".join(f"named_struct('rank', {r}, 't', {t}, 'at', {i})" for r, t, i in found)
        for w, found in sorted(postings.items())
    }
    index = "map(" + ", ".join(f"'{w}', array({e})" for w, e in entries.items()) + ")"
    runs = "array(" + ", ".join(literal(t.run) for t in templates) + ")"
    keys = "array(" + ", ".join(literal(t.key_words) for t in templates) + ")"
    labels = literal([t.label for t in templates])
    base = "array(" + ", ".join(str(t.base).lower() for t in templates) + ")"

    # Any text without the rarest word of each template has no place; lower() folds at least A-Z.
    lowered = F.lower("text")
    possible = None
    for word in sorted(set(rarest)):
        test = F.contains(lowered, F.lit(word))
        possible = test if possible is None else possible | test
    rows = docs.select("doc_id", F.array_remove(F.split("text", SEPARATORS), "").alias("raw"), possible.alias("possible"))
    none = "cast(array() as array<struct<w:string,i:int>>)"
    held = f"array_contains({literal(sorted(postings))}, x.w)"
    lower = f"translate(w, '{UPPER}', '{LOWER}')"
    rows = rows.withColumn(
        "found", F.expr(f"if(possible, filter(transform(raw, (w, i) -> named_struct('w', {lower}, 'i', i)), x -> {held}), {none})")
    )
    # A vote is one number: where the template would start, times the number of templates, plus the template.
    n = len(templates)
    places = [
        f"flatten(transform(found, x -> transform(filter({index}[x.w], p -> p.rank = {rank} and x.i >= p.at), "
        f"p -> cast(x.i - p.at as bigint) * {n} + p.t)))"
        for rank in range(anchors)
    ]
    agreed = f"array_distinct({places[0]})"
    for place in places[1:]:
        agreed = f"array_intersect({agreed}, {place})"
    rows = rows.select("doc_id", "raw", F.size("raw").cast("long").alias("n_words"), F.expr(agreed).alias("codes"))
    split_code = f"named_struct('t', cast(c % {n} as int), 'start', cast(c div {n} as int))"
    rows = rows.withColumn("agreed", F.expr(f"transform(codes, c -> {split_code})"))
    there = f"transform(slice(raw, c.start + 1, size({runs}[c.t])), w -> {lower})"
    share = f"size(filter({runs}[c.t], (w, i) -> get(p, i) = w)) / size({runs}[c.t])"
    checked = (
        f"transform(agreed, c -> transform(array({there}), p -> named_struct('t', c.t, 'start', c.start, "
        f"'key', slice(p, 1, size({keys}[c.t])) = {keys}[c.t], 'share', {share}))[0])"
    )
    rows = rows.select("doc_id", "n_words", F.expr(checked).alias("checked"))
    rows = rows.select("doc_id", "n_words", F.expr(f"filter(checked, c -> c.key and c.share >= {least})").alias("places"))
    rows = rows.withColumn("base", F.expr(f"transform(filter(places, c -> {base}[c.t]), c -> c.start)"))
    joined = "array_join(array_sort(array_distinct(transform({}, c -> {}[c.t]))), ',')"
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        F.expr(joined.format(f"filter(places, c -> {base}[c.t])", labels)).alias("base_labels"),
        F.expr(joined.format("places", labels)).alias("labels"),
        F.coalesce(F.expr("array_max(transform(places, c -> c.share))"), F.lit(0.0)).cast("double").alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> str:
    """DuckDB SQL with the same result: every place of every word is compared with every template."""
    rows = ", ".join(
        f"({i}, '{t.label}', {t.base}, {t.run}, {t.key_words})" for i, t in enumerate(templates)
    )
    return f"""
with t(t, label, base, run, key) as (values {rows}),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
p as (select doc_id, w, unnest(generate_series(1, len(w))) as i from w),
m as (select doc_id, i - 1 as start, label, base,
        len(list_filter(generate_series(1, len(run)), lambda k: w[i + k - 1] = run[k]))::double / len(run) as share
      from p join t on w[i] = key[1] where w[i:i + len(key) - 1] = key),
g as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word,
        max(start) filter (base) as last_word,
        list_sort(list_distinct(list(label) filter (base))) as b, list_sort(list_distinct(list(label))) as l,
        max(share) as score from m where share >= {least} group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(array_to_string(b, ','), '') as base_labels,
  coalesce(array_to_string(l, ','), '') as labels, coalesce(score, 0)::double as score
from w left join g using (doc_id)"""
