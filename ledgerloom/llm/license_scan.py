"""License scans: texts are brought to a canonical form, and their digests joined with those of known texts.

Canonical: lower case, copyright lines gone, equivalent spellings folded, everything but letters and digits one
space. The units scanned are each document as a whole and runs of its words: where the first words of a known text
stand, the digest of the run that is as long as that text is taken, and joined. A notice counts where its run begins a
line and ends one, the same or a later one, as notices stand on lines of their own and may be wrapped or marked as
comments. An entire licence of ``licenses/`` counts wherever its run stands. First words are met by one automaton over
all of them, so that the work on a text does not grow with the list. A line that begins with copyright, as one of
another wrapping may by chance, is dropped on both sides as always.

Defined cases: a null text counts as empty; a unit without letters or digits matches nothing. Runs that repeat in
a document count each time. Rows that repeat are scanned each on its own. The result has a row for every document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, release, text_or_empty

#: Words of a known text by which its runs are looked for.
HEAD_WORDS = 8
#: Known notices and short licence texts, by identifier.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
#: Equivalent spellings, the first word becomes the second.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("organisation", "organization"), ("favour", "favor"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("ver", "version"), ("v", "version")]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^a-z0-9]+"


def canonical_lines(text: Column) -> Column:
    """Canonical text whose lines, those without a word left out, are still apart."""
    bare = F.replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), F.lit("\n"), F.lit(" \n "))
    # Two spaces between words, so that each has its own on either side and neighbours are folded alike.
    spaced = F.concat(F.lit(" "), F.regexp_replace(bare, r"[^a-z0-9\n]+", "  "), F.lit(" "))
    folded = reduce(lambda c, ab: F.replace(c, F.lit(f" {ab[0]} "), F.lit(f" {ab[1]} ")), SPELLINGS, spaced)
    return F.trim(F.regexp_replace(F.replace(folded, F.lit("  "), F.lit(" ")), " *\n[ \n]*", "\n"), F.lit(" \n"))


def canonical(text: Column) -> Column:
    return F.translate(canonical_lines(text), "\n", " ")


#: What stands above an entire licence, apart from copyright lines.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"]}
TERMS_END = "END OF TERMS AND CONDITIONS"


def license_files() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(license, text) of the terms, and of every form that an entire document may have."""
    terms, forms = [], []
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        name, text = file.stem, file.read_text(encoding="utf-8")
        body = text[: text.index(TERMS_END) + len(TERMS_END)] if TERMS_END in text else text
        terms.append((name, body))
        forms += [(name, f) for f in dict.fromkeys([body, text, *(f"{t}\n\n{body}" for t in TITLES.get(name, []))])]
    return terms, forms


def known_texts(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> list[tuple[str, str, str]]:
    """(kind, license, canonical text) of the whole list; kinds are notice, terms and form."""
    terms, forms = license_files()
    rows = [("notice", k, t) for k, v in known.items() for t in v] + [("terms", *x) for x in terms] + [("form", *x) for x in forms]
    read = spark.createDataFrame(rows, "kind string, license string, t string").select("kind", "license", canonical(F.col("t")).alias("c"))
    return [tuple(r) for r in read.filter("c <> ''").collect()]


def _digest(words: str) -> str:
    return hashlib.sha256(words.encode()).hexdigest()


def _run_finder(texts: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of id, row and canonical lines to their digests: of the whole, and of runs that begin as one of the texts does."""
    lengths: dict[str, set[int]] = {}
    for t in texts:
        lengths.setdefault(" ".join(t.split(" ")[:HEAD_WORDS]), set()).add(len(t))

    def runs_of(lines: str, heads) -> list[dict]:  # noqa: ANN001
        flat, found = f" {lines.translate({10: 32})} ", []
        edges = f"\n{lines}\n"
        for last, head in heads.iter(flat):
            begin = last - len(head)
            for n in lengths[head]:
                end = begin + n
                if flat[end : end + 1] == " ":
                    found.append({"digest": _digest(flat[begin:end]), "lined": edges[begin - 1] == edges[end] == "\n"})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        heads = ahocorasick.Automaton()
        for head in lengths:
            heads.add_word(f" {head} ", head)
        heads.make_automaton()
        kind = pa.list_(pa.struct([("digest", pa.string()), ("lined", pa.bool_())]))
        for batch in batches:
            wholes, runs = [], []
            for value in batch.column("c"):  # one text at a time
                lines = value.as_py()
                wholes.append(_digest(lines.replace("\n", " ")))
                runs.append(runs_of(lines, heads) if len(heads) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(wholes, pa.string()), pa.array(runs, kind)], ["doc_id", "row", "text_sha256", "runs"])
        release()

    return run


def _by_digest(spark: SparkSession, rows: list[tuple], name: str) -> DataFrame:
    """digest, name, anywhere of a list of (kind, license, canonical text); the first name of equal texts."""
    made = spark.createDataFrame([(_digest(c), k, kind == "terms") for kind, k, c in rows], f"digest string, {name} string, anywhere boolean")
    return broadcast_if_small(made.groupBy("digest").agg(F.min(name).alias(name), F.max("anywhere").alias("anywhere")))


def scan_licenses(spark: SparkSession, docs: DataFrame, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """doc_id, text_sha256 (canonical whole text), text_license (or null), n_notices, licenses (of runs and the whole, sorted)."""
    listed = known_texts(spark, known)
    parts = [x for x in listed if x[0] != "form"]
    by_run, by_whole = _by_digest(spark, parts, "run_license"), _by_digest(spark, [x for x in listed if x[0] != "terms"], "text_license").drop("anywhere")
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(text_or_empty()).alias("c"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = base.mapInArrow(_run_finder([c for _, _, c in parts]), f"doc_id {kind}, row long, text_sha256 string, runs array<struct<digest:string,lined:boolean>>")
    runs = found.select("doc_id", "row", "text_sha256", F.explode_outer("runs").alias("run")).select("doc_id", "row", "text_sha256", "run.*")
    hits = runs.join(by_run, "digest", "left").withColumn("run_license", F.when(F.col("anywhere") | F.col("lined"), F.col("run_license")))
    per_doc = hits.groupBy("row", "doc_id", "text_sha256").agg(F.count("run_license").alias("n_notices"), F.collect_set("run_license").alias("found"))
    joined = per_doc.join(by_whole.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left")
    named = F.array_union("found", F.array_compact(F.array("text_license")))
    return joined.select("doc_id", "text_sha256", "text_license", "n_notices", F.array_join(F.sort_array(named), ",").alias("licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, documents(spark, sf_dir))


def _sql() -> str:
    """The same in SQL; spellings are folded word by word, notices are held against texts from the lines that they begin with, and entire licences counted by cutting texts at them."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = lambda pairs: ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in pairs)
    spelling = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS) + " ELSE w END"

    def canon(x: str) -> str:
        bare = f"trim(regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g'), '{NOT_WORD}', ' ', 'g'))"
        return f"array_to_string([{spelling} FOR w IN string_split({bare}, ' ')], ' ')"

    terms, forms = license_files()
    double = lambda c: f"' ' || replace({c}, ' ', '  ') || ' '"
    return f"""
WITH notices AS (SELECT min(license) AS license, {canon("t")} AS t, sha256({canon("t")}) AS digest FROM (VALUES {rows((k, t) for k, v in KNOWN.items() for t in v)}) AS k(license, t) GROUP BY ALL),
known AS (SELECT min(license) AS license, digest FROM
          (SELECT license, digest FROM notices UNION ALL SELECT license, sha256({canon("t")}) FROM (VALUES {rows(forms)}) AS k(license, t)) GROUP BY digest),
terms AS (SELECT license, {canon("t")} AS t FROM (VALUES {rows(terms)}) AS k(license, t)),
base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT *, sha256(c) AS text_sha256 FROM (SELECT base.*, {canon("text")} AS c FROM base)),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM base),
units AS (SELECT r, c, sum(length(c) + 1) OVER (PARTITION BY r ORDER BY i) AS upto FROM (SELECT r, i, {canon("line")} AS c FROM split) WHERE c <> ''),
begun AS (SELECT r, license, t, upto - length(units.c) AS "begin", whole.c FROM units JOIN notices ON starts_with(t, units.c) JOIN whole USING (r)),
hits AS (SELECT begun.r, license FROM begun JOIN units ON units.r = begun.r AND upto = "begin" + length(t) WHERE substr(begun.c, "begin"::BIGINT, length(t)) = t),
entire AS (SELECT r, license, len(string_split({double("c")}, {double("t")})) - 1 AS n FROM whole JOIN terms ON contains(c, t)),
found AS (SELECT r, license, 1 AS n FROM hits UNION ALL SELECT * FROM entire WHERE n > 0 UNION ALL
         SELECT r, license, 0 FROM whole JOIN known ON text_sha256 = digest)
SELECT doc_id, text_sha256, any_value(k.license) AS text_license, coalesce(sum(n), 0)::BIGINT AS n_notices,
       coalesce(string_agg(DISTINCT found.license, ',' ORDER BY found.license), '') AS licenses
FROM whole LEFT JOIN found USING (r) LEFT JOIN known k ON text_sha256 = k.digest GROUP BY whole.r, doc_id, text_sha256
"""


OP9_SQL = _sql()
