"""Rules over records, and what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import casefolded, identity_tokens, number_tokens, two_letter_folded

ATTRIBUTION = 0.5
#: Words of file names that name no product, in any line of business.
GENERIC = (
    "versicherung", "versicherungsbedingungen", "allgemeine", "produktinformationsblatt", "weitere", "unterlagen", "ag", "se", "gmbh",
    "und", "mit", "der", "die", "das", "fuer", "von", "als", "pdf", "kombiniert", "besondere",
)


def check(value: Column, kind: Column, expected: Column) -> Column:
    """Whether a value meets a rule: eq, nonnull, isnull, contains, contains_all_digits or in (expected parted by |)."""
    wanted = F.split(expected, r"\|")
    return (
        F.when(kind == "eq", value.eqNullSafe(expected))
        .when(kind == "nonnull", ~F.coalesce(value, F.lit("")).isin("", "[]"))
        .when(kind == "isnull", value.isNull())
        .when(kind == "contains", F.coalesce(F.contains(F.lower(value), F.lower(expected)), F.lit(False)))
        .when(kind == "contains_all_digits", F.size(F.array_except(wanted, number_tokens(value))) == 0)
        .when(kind == "in", F.coalesce(F.array_contains(wanted, value), F.lit(False)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown check "), kind)).cast("boolean"))
    )


def invariants(values: DataFrame, rules: DataFrame) -> DataFrame:
    """stem, path, check, ok of every rule: values (stem, path, value) held against rules (stem, path, check, expected).

    A rule without a value is held against null.
    """
    joined = rules.join(values, ["stem", "path"], "left")
    return joined.select("stem", "path", "check", check(F.col("value"), F.col("check"), F.col("expected")).alias("ok"))


def passed(results: DataFrame) -> DataFrame:
    """One row: passed, total, failures (sorted)."""
    return results.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.concat_ws(" ", "stem", "path", "check")))).alias("failures"))


def attribution(entries: DataFrame, own_generic: tuple[str, ...] = ()) -> DataFrame:
    """stem, hits, wanted, share, ok: how many words of the product's name its file names hold.

    entries: stem, tariff, files array<string>. Words of GENERIC, and those of the line of business itself, do not count.
    Without words on either side nothing can be said, which passes.
    """
    generic = (*GENERIC, *own_generic)
    wanted = identity_tokens(F.col("tariff"), generic)
    have = identity_tokens(F.concat_ws(" ", "files"), generic)
    hits = F.size(F.filter(wanted, lambda t: F.array_contains(have, t)))
    share = F.try_divide(hits, F.size(wanted))
    ok = (F.size(wanted) == 0) | (F.size(have) == 0) | (share >= ATTRIBUTION)
    return entries.select("stem", hits.cast("long").alias("hits"), F.size(wanted).cast("long").alias("wanted"), share.alias("share"), ok.alias("ok"))


def staleness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """stem, doctype, state (added, dropped, changed) of recorded and current document digests.

    Both: stem, doctype, content_sha256. Stems without any current document are left out: nothing is known of them.
    """
    known = current.select("stem").distinct()
    r = recorded.join(known, "stem", "left_semi").select("stem", "doctype", F.col("content_sha256").alias("old"))
    c = current.join(recorded.select("stem").distinct(), "stem", "left_semi").select("stem", "doctype", F.col("content_sha256").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.col("old") != F.col("new"), "changed")
    return r.join(c, ["stem", "doctype"], "full_outer").withColumn("state", state).filter("state IS NOT NULL").select("stem", "doctype", "state")


def pin_repairs(values: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values with every pinned-null path emptied, and the log of what was there."""
    pins = rules.filter("check = 'isnull'").select("stem", "path").distinct().withColumn("__pin", F.lit(True))
    joined = values.join(pins, ["stem", "path"], "left")
    repaired = joined.withColumn("value", F.when(F.col("__pin").isNull(), F.col("value"))).drop("__pin")
    return repaired, joined.filter("__pin AND value IS NOT NULL").select("stem", "path", "value")


def dominant(records: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """The commonest combination of some columns; of equally common ones the first seen."""
    grouped = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("__first"))
    return grouped.orderBy(F.col("n").desc(), "__first").limit(1).drop("__first")


def draft_problems(draft: DataFrame) -> DataFrame:
    """name, problem: drafts of a vertical (name, keys, anchors, synonyms) that break a rule of form."""
    test = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.lit(text))
    problems = F.array_compact(F.array(
        test(~F.size("keys").between(3, 12), "3 to 12 keys"),
        test(F.exists("keys", lambda k: ~F.rlike(k, F.lit("^[a-z][a-z0-9_]*$"))), "keys in snake case"),
        test(F.size("anchors") < 3, "3 anchors at least"),
        test(F.size("synonyms") < 5, "5 synonyms at least"),
    ))
    return draft.select("name", F.explode(problems).alias("problem"))


def bundle_fits(entries: DataFrame) -> DataFrame:
    """stem, fits: whether the files and links of a bundle name its insurer at all.

    entries: stem, insurer, docs array<struct<file, url>>. Words of four letters and more are looked for anywhere in the
    names; an insurer without any cannot be checked, which passes.
    """
    blob = two_letter_folded(F.concat_ws(" ", F.transform("docs", lambda d: F.concat_ws(" ", F.coalesce(d["file"], F.lit("")), F.coalesce(d["url"], F.lit(""))))))
    words = F.filter(F.split(two_letter_folded(F.coalesce("insurer", F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)
    return entries.select("stem", ((F.size(words) == 0) | F.exists(words, lambda w: F.contains(blob, w))).alias("fits"))


def evidence(scope: Column, subject: Column, given: Column) -> Column:
    """The words that a page must still hold for a verdict to stand: those given, else the subject's own name."""
    own = F.when(scope == "tariff", F.split_part(subject, F.lit("__"), F.lit(1))).otherwise(F.split_part(subject, F.lit("/"), F.lit(1)))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.array(F.replace(own, F.lit("-"), F.lit(" "))))


def verdict_states(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """scope, subject, url, state, missing of every rating with a link and a date, held against its page.

    entries: scope, subject, url, stand, evidence array<string>. pages: url, plain, page_stand. A page that was not read or
    prints no date is a failure. Evidence that is gone asks for a review, whatever the dates; so does a recorded date
    after the page's. The same date is ok, an earlier one pending.
    """
    asked = entries.filter("coalesce(url, '') <> '' AND coalesce(stand, '') <> ''").withColumn("__want", evidence(F.col("scope"), F.col("subject"), F.col("evidence")))
    met = asked.join(pages.select("url", casefolded(F.col("plain")).alias("__plain"), F.col("page_stand").cast("string").alias("__at")), "url", "left")
    missing = F.filter("__want", lambda t: ~F.contains("__plain", casefolded(t)))
    state = (
        F.when(F.col("__plain").isNull() | F.col("__at").isNull(), "failed").when(F.size(missing) > 0, "review")
        .when(F.col("stand") == F.col("__at"), "ok").when(F.col("stand") < F.col("__at"), "pending").otherwise("review")
    )
    return met.select("scope", "subject", "url", state.alias("state"), F.when(state != "failed", missing).alias("missing"))


def newest_stands(entries: DataFrame) -> DataFrame:
    """url, stand: the latest recorded date of each linked page."""
    return entries.filter("coalesce(url, '') <> ''").groupBy("url").agg(F.max("stand").alias("stand"))


def shape_errors(values: DataFrame, declared: DataFrame, most: int = 5) -> DataFrame:
    """stem, path, message: the first errors of each record against a declared shape, by path.

    values: stem, path, kind (JSON type of what is there), value. declared: path, kind, required. What is required must
    be there, what is there must be declared and of the declared kind; null only where the kind says so (``string?``).
    """
    stems = values.select("stem").distinct()
    lacking = stems.join(F.broadcast(declared.filter("required").select("path")), F.lit(True)).join(values.select("stem", "path"), ["stem", "path"], "left_anti")
    lacking = lacking.withColumn("message", F.lit("is required"))
    met = values.join(F.broadcast(declared.select("path", F.col("kind").alias("__kind"))), "path", "left")
    bare = F.rtrim("__kind", F.lit("?"))
    allowed = (F.col("kind") == bare) | ((F.col("kind") == "null") & F.endswith("__kind", F.lit("?")))
    message = F.when(F.col("__kind").isNull(), "is not declared").when(~allowed, F.concat(F.col("kind"), F.lit(" is not "), F.col("__kind")))
    wrong = met.withColumn("message", message).filter("message IS NOT NULL").select("stem", "path", "message")
    place = F.row_number().over(Window.partitionBy("stem").orderBy("path", "message"))
    return lacking.unionByName(wrong).withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")
