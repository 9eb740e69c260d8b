"""License scans by sentence rules.

Method
------
1. Texts are cut into sentences at line ends and after full stops, question and exclamation
   marks and semicolons that white space follows.
2. Sentences are normalised: lower case, spellings of licence, comment signs and other signs
   dropped, white space made one space.
   A known sentence may go over several lines of a paragraph: lines are also read together
   with those that follow, up to a full stop, a blank line or a line of signs only. If that
   finds one, unknown sentences of the text are counted whole, else line by line.
3. A table gives known licence sentences their identifiers; some are matched by a pattern,
   since names and years stand in them.
4. Identifiers of neighbouring known sentences (no more than ``GAP`` unknown ones between
   them) form a sequence. Ordered rules read each sequence; the first rule whose sequence of
   identifiers occurs in it, one after another, names the licence, and what it used up is
   not read again. Known sentences that no rule uses are ``unknown``.

All of it is built-in expressions on one row, so there is no shuffle. The DuckDB form reads
single lines only; both agree on texts without wrapped or widely spaced licence sentences.

Cases
-----
Null, empty and blank texts have no sentences and the licence list is empty. A sentence that
is repeated counts each time; licences are listed once, in the order of the rules. Rows that
repeat a doc_id, null doc_ids and extra columns: one result a row, other columns not read.
Very long texts: read whole, with any number of known sentences. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2

# Normalised licence sentences by identifier, as patterns over the whole sentence.
SENTENCES = {
    "gpl3": "this work is licensed under the gnu general public license,? version 3",
    "gpl-any": "this (program|work) is free software you can redistribute it and/or modify it under the terms of the gnu general public license.*",
    "apache2": "licensed under the apache license,? version 2.0( the license)?",
    "apache-copy": "you may obtain a copy of the license at.*",
    "mit-name": "released under the mit license",
    "mit-grant": "permission is hereby granted,? free of charge,? to any person obtaining a copy of this software.*",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies.*",
    "as-is": "the software is provided as is,? without warranty of any kind.*",
    "bsd-grant": "redistribution and use in source and binary forms,? with or without modification,? are permitted.*",
    "bsd-names": "neither the name of .* nor the names of its contributors may be used.*",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by-sa 4.0",
    "cc-by-nc": "licensed under cc by-nc 4.0",
    "cc0": "(dedicated to the public domain|licensed under cc0 1.0)",
    "reserved": "all rights reserved",
    "copyright": "copyright (c )?[0-9]{4}.*",
}
# (Identifiers in order, licence, kind); the first rule that matches counts.
RULES = [
    (("mit-grant", "mit-notice", "as-is"), "MIT", "permissive"),
    (("bsd-grant", "bsd-names"), "BSD-3-Clause", "permissive"),
    (("bsd-grant",), "BSD-2-Clause", "permissive"),
    (("apache2", "apache-copy"), "Apache-2.0", "permissive"),
    (("gpl-any",), "GPL", "copyleft"),
    (("gpl3",), "GPL-3.0", "copyleft"),
    (("apache2",), "Apache-2.0", "permissive"),
    (("mit-name",), "MIT", "permissive"),
    (("cc0",), "CC0-1.0", "permissive"),
    (("cc-by-sa",), "CC-BY-SA-4.0", "copyleft"),
    (("cc-by-nc",), "CC-BY-NC-4.0", "restricted"),
    (("cc-by",), "CC-BY-4.0", "permissive"),
    (("copyright", "reserved"), "All-Rights-Reserved", "restricted"),
    (("reserved",), "All-Rights-Reserved", "restricted"),
]
#: Any known sentence holds one of these, so other sentences are not normalised at all.
HINT = "(?i)licen[sc]e|copyright|rights reserved|redistribut|permission|public domain|warranty|free software|the names? of"
#: The same with any white space or signs between the words, as at the ends of wrapped lines.
WIDE_HINT = HINT.replace(" ", "[^a-zA-Z0-9]+")
#: A text's paragraph ends are marked before it is split.
MARK = "\u0001"
PARAGRAPH_END = "(\\S)(?=[^\\S\\n]*\\n\\s*\\n)"
SPLIT = f"\\n+|(?<=[.!?;]{MARK}?)\\s+"


def wrapped(pattern: str) -> str:
    """A sentence's pattern over lines that ends of lines part, up to the end of a line."""
    if pattern.endswith(".*"):
        pattern = pattern[:-2] + "[^\\n|]*"
    pattern = pattern.replace(" .* ", " [^|@]*? ").replace(" ", "[ \\n]")
    return f"(?m)^(?:{pattern})(?=[\\n|]|\\z)"


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.lower(sentence), "licence", "license")
    plain = F.regexp_replace(plain, "[^a-z0-9 .,/-]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, " +", " "), " ([.,])", "$1")
    return F.regexp_replace(plain, "^[ .,/-]+|[ .,/-]+$", "")


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null for an unknown one."""
    known = None
    for name, pattern in SENTENCES.items():
        hit = sentence.rlike(f"^(?:{pattern})$")
        known = F.when(hit, name) if known is None else known.when(hit, name)
    return known


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def marked_lines(text: Column) -> Column:
    """Lines of normalised sentences or parts of them: '@id' for known ones, '@+id' for those
    that were wrapped over lines, '|' after the last line of a sentence or paragraph."""
    lines = F.filter(F.split(F.regexp_replace(text, PARAGRAPH_END, "$1" + MARK), SPLIT), lambda s: F.trim(s) != "")
    plain = F.transform(lines, lambda s: F.struct(s.alias("s"), normalised(s).alias("n")))
    read = F.transform(
        plain,
        lambda x: F.concat(
            F.coalesce(F.when(x["s"].rlike(WIDE_HINT), F.concat(F.lit("@"), identifier(x["n"]))), x["n"]),
            F.when((x["n"] == "") | x["s"].rlike(f"[.!?;{MARK}]\\s*$"), "|").otherwise(""),
        ),
    )
    out = F.array_join(read, "\n")
    for name, pattern in SENTENCES.items():
        out = F.regexp_replace(out, wrapped(pattern), f"@+{name}")
    return out


def sequences(text: Column) -> Column:
    """Known sentences of a text in order: 'id ' each, and '| ' where a sequence ends."""

    def placed(lines: Column) -> Column:
        # Places are lines, or whole sentences where a known one is wrapped.
        parts = F.when(lines.contains("@+"), F.split(lines, "\\|[\\n|]*")).otherwise(F.split(lines, "\n"))
        return F.flatten(
            F.transform(
                parts,
                lambda part, i: F.transform(
                    F.regexp_extract_all(part, F.lit("@\\+?([a-z0-9-]+)"), F.lit(1)),
                    lambda name: F.struct(i.alias("place"), name.alias("id")),
                ),
            )
        )

    def joined(known: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            apart = x["place"] - F.get(known, i - 1)["place"] > GAP + 1
            return F.concat(F.when(apart, "| ").otherwise(""), x["id"], F.lit(" "))

        return F.array_join(F.transform(known, entry), "")

    return bound(bound(marked_lines(text), placed), joined)


def between(ids: tuple[str, ...]) -> str:
    """Identifiers of one sequence in order; others may stand between them.

    What stands between is a run of characters, not of words: Java reads a repeated group by
    recursion, which a text of some thousand known sentences would carry too deep.
    """
    return "([a-z0-9 -]*?)".join(f" {i} " for i in ids)


def scan(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, n_license_sentences, sequence, licenses, kinds, n_unknown)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").rlike(WIDE_HINT), sequences(F.col("text"))).otherwise("").alias("sequence"),
    )
    rows = rows.withColumn("sequence", F.coalesce("sequence", F.lit("")))
    left, found, kinds = F.regexp_replace("sequence", "([^ ]+) ", " $1 "), [], []
    for ids, name, kind in RULES:
        pattern = between(ids)
        rest = "".join(f"${k}" for k in range(1, len(ids)))
        hit = left.rlike(pattern)
        found.append(F.when(hit, name))
        kinds.append(F.when(hit, kind))
        left = F.regexp_replace(left, pattern, rest)
    return rows.select(
        "doc_id",
        F.size(F.filter(F.split("sequence", " "), lambda x: (x != "") & (x != "|"))).cast("long").alias("n_license_sentences"),
        F.rtrim("sequence").alias("sequence"),
        F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*found)))).alias("licenses"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*kinds))))).alias("kinds"),
        F.size(F.filter(F.split(left, " "), lambda x: (x != "") & (x != "|"))).cast("long").alias("n_unknown"),
    )


def duckdb_sql() -> str:
    """DuckDB form of the query op1_license_scan, from the same tables of sentences and rules."""
    cases = " ".join(f"when regexp_matches(n, '^(?:{p})$') then '{i}'" for i, p in SENTENCES.items())
    left, names, kinds = "regexp_replace(sequence, '([^ ]+) ', ' \\1 ', 'g')", [], []
    steps = []
    for k, (ids, name, kind) in enumerate(RULES):
        pattern = between(ids)
        rest = "".join(f"\\{g}" for g in range(1, len(ids)))
        steps.append(
            f"r{k} as (select *, regexp_matches(left{k}, '{pattern}') as hit{k}, "
            f"regexp_replace(left{k}, '{pattern}', '{rest}', 'g') as left{k + 1} from "
            + (f"r{k - 1})" if k else f"(select *, {left} as left0 from q))")
        )
        names.append(f"case when hit{k} then '{name}' end")
        kinds.append(f"case when hit{k} then '{kind}' end")
    held = "len(list_filter(string_split({}, ' '), lambda x: x not in ('', '|')))::bigint"
    several = (
        "array_to_string(list_filter(list_transform(range(1, {n} + 1), lambda i: "
        "case when list_position({v}, {v}[i]) = i then {v}[i] end), lambda x: x is not null), ',')"
    )
    last = len(RULES)
    return f"""
with s as (
  select doc_id, generate_subscripts(a, 1) as place, unnest(a) as s from (
    select doc_id, list_filter(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1\n', 'g'), chr(10)),
      lambda x: trim(x) <> '') as a from documents)),
n as (
  select doc_id, place, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s),
    'licence', 'license', 'g'), '[^a-z0-9 .,/-]+', ' ', 'g'), ' +', ' ', 'g'), ' ([.,])', '\\1', 'g'), '^[ .,/-]+|[ .,/-]+$', '', 'g') as n
  from s where regexp_matches(s, '{HINT}')),
i as (select doc_id, place, case {cases} end as id from n),
g as (
  select *, place - lag(place) over (partition by doc_id order by place) > {GAP + 1} as apart
  from i where id is not null),
t as (
  select doc_id, string_agg(case when apart then '| ' else '' end || id || ' ', '' order by place) as sequence
  from g group by doc_id),
q as (select d.doc_id, coalesce(t.sequence, '') as sequence from documents d left join t using (doc_id)),
{", ".join(steps)},
v as (select *, [{", ".join(names)}] as names, list_sort(list_distinct([{", ".join(kinds)}])) as kinds from r{last - 1})
select doc_id, {held.format("sequence")} as n_license_sentences, rtrim(sequence) as sequence,
  {several.format(n=last, v="names")} as licenses,
  array_to_string(list_filter(kinds, lambda x: x is not null), ',') as kinds, {held.format(f"left{last}")} as n_unknown
from v
"""


SQL = duckdb_sql()
