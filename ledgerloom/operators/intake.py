"""Documents on their way in: what their names and links say, where they are put, which of them ask for the same work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slug, url_decoded, url_slug
from .trimming import _bound

#: Words of a link or its text that tell a kind of document, the first that is found; None is no document of a product.
LINK_WORDS = (("erstinformation", None), ("versicherungsbedingungen", "avb"), ("avb", "avb"), ("informationsblatt", "produktinfoblatt"), ("ipid", "produktinfoblatt"))
TERMS, MORE_TERMS, OTHER = "avb", "avb_besondere", "weitere_unterlagen"


def file_identity(file: Column, prefixes: list[tuple[str, str]], insurers: dict[str, str], boilerplate: list[str]) -> Column:
    """A struct of doctype, insurer, tariff, stem and warnings, read from a file name.

    Blanks and underscores part words. A prefix counts only as whole words, the first of the list wins; the insurer is the
    first known word, else the first that is no boilerplate, which a warning says; the tariff is what is left. Null is the
    empty name: no doctype, both names unknown. Each step is computed once for a name.
    """
    name = F.regexp_replace(F.coalesce(url_decoded(file), file, F.lit("")), r"(?i)\.pdf$", "")
    name = F.trim(F.regexp_replace(name, "[ _]+", "_"), F.lit("_"))
    names = F.create_map(*(F.lit(x) for pair in insurers.items() for x in pair)) if insurers else F.create_map().cast("map<string,string>")
    plain = lambda w: ~F.lower(w).isin(boilerplate)

    def parted(name: Column) -> Column:
        begins = lambda p: F.startswith(F.concat(F.lower(name), F.lit("_")), F.lit(f"{p}_"))
        told = F.coalesce(*(F.when(begins(p), F.struct(F.lit(d).alias("doctype"), F.lit(len(p)).alias("n"))) for p, d in prefixes))
        return _bound(told, lambda t: _bound(F.filter(F.split(_rest(name, t["n"]), "_"), lambda w: w != ""), lambda ws: guessed(t["doctype"], ws)))

    def guessed(doctype: Column, words: Column) -> Column:
        known = F.try_element_at(F.filter(words, lambda w: F.lower(w).isin(list(insurers))), F.lit(1))
        guess = F.try_element_at(F.filter(words, plain), F.lit(1))
        both = F.struct(known.alias("known"), guess.alias("guess"))
        return _bound(both, lambda b: read(doctype, words, b["known"], b["guess"]))

    def read(doctype: Column, words: Column, known: Column, guess: Column) -> Column:
        of = F.lower(F.coalesce(known, guess))
        insurer = F.coalesce(F.try_element_at(names, F.lower(known)), F.nullif(url_slug(guess), F.lit("")))
        left = F.filter(words, lambda w: plain(w) & ~F.lower(w).eqNullSafe(of))
        tariff = F.coalesce(F.nullif(url_slug(F.array_join(left, "-")), F.lit("")), F.lit("unbenannt"))
        return _bound(F.struct(insurer.alias("insurer"), tariff.alias("tariff")), lambda r: told_of(doctype, known, r["insurer"], r["tariff"]))

    def told_of(doctype: Column, known: Column, insurer: Column, tariff: Column) -> Column:
        warnings = F.array_compact(F.array(F.when(doctype.isNull(), "unknown document type"), F.when(known.isNull() & insurer.isNotNull(), "insurer guessed")))
        stem = F.concat(F.coalesce(insurer, F.lit("unbekannt")), F.lit("__"), tariff)
        return F.struct(doctype.alias("doctype"), insurer.alias("insurer"), tariff.alias("tariff"), stem.alias("stem"), warnings.alias("warnings"))

    return _bound(name, parted)


def _rest(name: Column, n: Column) -> Column:
    return F.ltrim(F.substr(name, F.coalesce(n, F.lit(0)) + 1), F.lit("_ -"))


def orphans(found: DataFrame, known: DataFrame) -> DataFrame:
    """The stems of files that no known entry bears, once each."""
    return found.select("stem").distinct().join(known.select("stem").distinct(), "stem", "left_anti")


def link_doctypes(links: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The links of each bundle that are taken, with their doctype: each at most once, a second set of terms as a special one.

    links: bundle, ordinal, text, url, kind. A known kind tells the doctype, else the words of text and address do; links
    without any such word are further papers, broker information is left out. Null text or address counts as empty.
    """
    said = F.lower(F.concat_ws(" ", "text", "url"))
    by_words = reduce(lambda otherwise, w: F.when(F.contains(said, F.lit(w[0])), F.lit(w[1])).otherwise(otherwise), reversed(LINK_WORDS), F.lit(OTHER))
    by_kind = reduce(lambda otherwise, k: F.when(F.col("kind") == k[0], F.lit(k[1])).otherwise(otherwise), kinds.items(), F.lit(None).cast("string"))
    named = links.withColumn("doctype", F.coalesce(by_kind, by_words)).filter("doctype IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("bundle", "doctype").orderBy("ordinal"))
    named = named.withColumn("doctype", F.when((F.col("doctype") == TERMS) & (place > 1), MORE_TERMS).otherwise(F.col("doctype")))
    return named.withColumn("__n", place).filter("__n = 1").drop("__n")


def safe_segment(segment: Column) -> Column:
    """A name that may stand in a path; anything that would leave its folder fails the job."""
    unsafe = segment.isNull() | segment.isin("", ".", "..") | F.contains(segment, F.lit("/")) | F.contains(segment, F.lit("\\"))
    return F.when(~unsafe, segment).otherwise(F.raise_error(F.concat(F.lit("unsafe segment "), F.coalesce(segment, F.lit("null")))))


def targets(documents: DataFrame, within: list[str], name: Column, order: list[str], suffix: str = ".pdf") -> DataFrame:
    """``target`` of each document: its name, from the second of one name on with its number, in the order given.

    Names are told apart within the columns ``within`` (none: everywhere). A numbered name that another document bears
    itself has the digest of its place appended, so that no two targets are one.
    """
    base = F.regexp_replace(safe_segment(F.coalesce(F.nullif(F.regexp_extract(name, r"([^/]*)$", 1), F.lit("")), F.lit("unnamed"))), r"(?i)\.pdf$", "")
    named = documents.withColumn("__base", base)
    named = named.withColumn("__n", F.row_number().over(Window.partitionBy(*within, "__base").orderBy(*order)))
    named = named.withColumn("__name", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__n").cast("string"))))
    clash = F.row_number().over(Window.partitionBy(*within, "__name").orderBy("__n", *order))
    told = F.sha2(F.to_json(F.struct("__base", "__n")), 256)
    whole = F.when(clash == 1, F.col("__name")).otherwise(F.concat_ws("-", "__name", told))
    return named.withColumn("target", F.concat(whole, F.lit(suffix))).drop("__base", "__n", "__name")


def signature(docs: Column, version: str, model: Column, trim: Column, repeat: Column) -> Column:
    """sha256 of all that an extraction depends on: version, model, trimming, number of runs beyond one, documents in order."""
    runs = F.when(repeat > 1, F.concat(F.lit("repeat="), repeat.cast("string")))
    parts = F.transform(docs, lambda d: F.concat_ws(":", d["doctype"], d["content_sha256"]))
    return F.sha2(F.concat_ws("|", F.lit(version), F.concat(F.lit("model="), model), F.concat(F.lit("filter="), trim), runs, F.concat_ws("|", parts)), 256)


def echoes_stem(stem: Column, insurer: Column, tariff: Column) -> Column:
    """Whether a record says no more of its identity than the name it is filed under; both halves must."""
    half = lambda n: F.split_part(stem, F.lit("__"), F.lit(n))
    said = lambda c: slug(F.coalesce(c, F.lit("")))
    return (said(insurer) == half(1)) & (said(tariff) == F.substr(stem, F.length(half(1)) + 3))


def seeds(records: DataFrame) -> DataFrame:
    """signature, seed: of the records of one signature the first that does not merely echo its stem.

    records: stem, insurer, tariff, signature. A signature of echoes alone has no seed; records without one are not shared.
    """
    sound = records.filter(F.col("signature").isNotNull() & ~echoes_stem(F.col("stem"), F.col("insurer"), F.col("tariff")))
    return sound.groupBy("signature").agg(F.min("stem").alias("seed"))


def positions(spec: Column) -> Column:
    """A struct of the numbers of a comma list, sorted and once each, and of what is none, as it stands."""
    words = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")
    number = lambda w: F.rlike(w, F.lit("^[0-9]+$"))
    taken = F.array_sort(F.array_distinct(F.transform(F.filter(words, number), lambda w: w.cast("long"))))
    return F.struct(taken.alias("taken"), F.filter(words, lambda w: ~number(w)).alias("ignored"))
