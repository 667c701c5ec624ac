"""Text as columns: keys, folds, numbers in German notation, labels of free text. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two kinds of space that do not break.
HARD_SPACES = chr(0xA0) + chr(0x202F)


def squeezed(s: Column) -> Column:
    """Inner white space of any kind becomes one space, outer goes, null becomes empty."""
    plain = F.translate(F.coalesce(s, F.lit("")), HARD_SPACES, "  ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def casefolded(s: Column) -> Column:
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def two_letter_folded(s: Column) -> Column:
    """Lower case, each umlaut and sharp s as two letters."""
    folded = F.lower(s)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return folded


def slug(s: Column) -> Column:
    """Lower case, umlauts as two letters, all else runs of a hyphen."""
    return F.regexp_replace(F.regexp_replace(two_letter_folded(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(insurer: Column, product: Column) -> Column:
    return F.concat(slug(insurer), F.lit("__"), slug(product))


def url_decoded(s: Column) -> Column:
    """Percent decoding that leaves plus signs alone."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def url_slug(s: Column) -> Column:
    return slug(F.coalesce(url_decoded(s), s))


def file_of_url(url: Column) -> Column:
    """The decoded last path segment without its .pdf."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    last = url_decoded(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(last, r"(?i)\.pdf$", "")


def money(s: Column) -> Column:
    """'1.234,56 EUR' -> 1234.56. The sign is not read; what holds no number is null."""
    kept = F.replace(F.replace(F.regexp_replace(s, "[^0-9.,]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return kept.try_cast("double")


def grade(s: Column) -> Column:
    """'1,0' -> 1.0; blank and anything else null."""
    return F.replace(F.trim(s), F.lit(","), F.lit(".")).try_cast("double")


def sharp_s_folded(s: Column) -> Column:
    return F.replace(s, F.lit("ß"), F.lit("ss"))


def vowel_folded(s: Column) -> Column:
    """Lower case, each umlaut as its vowel, sharp s as ss; for loose matching only."""
    return F.replace(F.translate(F.lower(s), "äöü", "aou"), F.lit("ß"), F.lit("ss"))


#: What may stand before a list item.
LEADING_MARKS = "✓✗★•·–— -"


def item_key(s: Column) -> Column:
    """What makes two list items the same: trademarks gone, folded, leading marks gone, spaces of any kind squeezed."""
    bare = casefolded(F.translate(F.coalesce(s, F.lit("")), "®™", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, f"^[{LEADING_MARKS}]+", ""), r"(?U)\s+", " "))


def number_tokens(s: Column) -> Column:
    """Whole numbers of a German text in order: grouping is dropped, decimals are not read."""
    plain = F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), HARD_SPACES, "  "), r",\d+", "")
    found = F.regexp_extract_all(plain, F.lit(r"(\d{1,3}(?:[.\s]\d{3})+|\d+)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[.\s]", ""))


def first_numbers(s: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(number_tokens(s)), 1, limit)


def short_sum(s: Column) -> Column:
    """A sum insured in few characters, limits of every variant kept."""

    def token(x: Column) -> Column:
        n = x.try_cast("decimal(38,0)")
        millions = F.regexp_replace(F.regexp_replace((n / F.lit(1_000_000)).cast("decimal(38,4)").cast("string"), r"0+$", ""), r"\.$", "")
        return (
            F.when(n >= 1_000_000, F.concat(F.replace(millions, F.lit("."), F.lit(",")), F.lit(" Mio.")))
            .when(n >= 1000, F.concat((n / 1000).cast("decimal(38,3)").cast("string").substr(F.lit(1), F.length((n / 1000).cast("decimal(38,3)").cast("string")) - 4), F.lit(" Tsd.")))
            .otherwise(n.cast("string"))
        )

    unlimited = F.contains(F.lower(s), F.lit("unbegrenzt"))
    numbers = F.array_distinct(F.transform(number_tokens(s), token))
    parts = F.when(unlimited, F.concat(numbers, F.array(F.lit("unbegr.")))).otherwise(numbers)
    alone = F.when(F.length(F.trim(s)) > len("unbegrenzt") + 1, "unbegrenzt*").otherwise("unbegrenzt")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "k.A.")
        .when(unlimited & (F.size(numbers) == 0), alone)
        .when(F.size(parts) == 0, s)
        .otherwise(F.array_join(parts, "/"))
    )


def short_deductible(s: Column) -> Column:
    none = F.when(F.contains(F.lower(s), F.lit("ohne")), F.array(F.lit("ohne"))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(none, first_numbers(s, 2))
    return F.when(F.coalesce(s, F.lit("")) == "", "k.A.").when(F.size(parts) == 0, s).otherwise(F.concat(F.array_join(parts, "/"), F.lit(" €")))


def short_scope(s: Column) -> Column:
    low = F.lower(s)
    world = F.contains(low, F.lit("weltweit")) | F.contains(low, F.lit("ww"))
    return F.when(F.coalesce(s, F.lit("")) == "", "k.A.").when(F.contains(low, F.lit("europa")), F.when(world, "Europa+ww. temp.").otherwise("Europa")).otherwise(s)


def short_term(s: Column) -> Column:
    low, numbers = F.lower(s), first_numbers(s, 8)
    daily = F.when(F.contains(low, F.lit("tägl")) | F.contains(low, F.lit("taegl")), ", tägl.").otherwise("")
    return F.when(F.coalesce(s, F.lit("")) == "", "k.A.").when(F.size(numbers) == 0, s).otherwise(F.concat(F.array_join(numbers, "/"), F.lit(" J."), daily))


def short_wait(months: Column) -> Column:
    return F.coalesce(F.concat(months.cast("string"), F.lit(" Mon.")), F.lit("k.A."))


def identity_tokens(s: Column, generic: tuple[str, ...] = ()) -> Column:
    """ASCII words of two letters or more, without the generic ones; accents fold to their letter, sharp s goes."""
    accents = F.translate(F.coalesce(s, F.lit("")), "ÄÖÜäöüÁÀÂÉÈÊÍÌÎÓÒÔÚÙÛÇÑáàâéèêíìîóòôúùûçñß", "AOUaouAAAEEEIIIOOOUUUCNaaaeeeiiiooouuucn")
    words = F.split(F.regexp_replace(F.lower(accents), r"[^\x00-\x7f]", ""), "[^a-z0-9]+")
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~F.coalesce(F.array_contains(F.array(*map(F.lit, generic)), t), F.lit(False)) if generic else F.length(t) >= 2)


def word_set(name: Column, *others: Column) -> Column:
    """Distinct whole words: of a name with umlauts as two letters, as keys are written, and of the others as they are."""
    joined = F.concat_ws(" ", two_letter_folded(name), *map(casefolded, others))
    return F.array_distinct(F.filter(F.split(joined, "[^a-z0-9]+"), lambda t: t != ""))


def file_token(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Za-z0-9.+_-]", "_")


def unfenced(s: Column) -> Column:
    """A reply without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def dehyphenated(s: Column) -> Column:
    """Words that a line break split at a hyphen, joined again where the rest begins in lower case."""
    return F.when(F.contains(s, F.lit("-\n")), F.regexp_replace(s, "([A-Za-zÀ-ÿ])-\n([a-zà-ÿ])", "$1$2")).otherwise(s)


#: The entities that pages use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&euro;", "€"), ("&amp;", "&"))


def entities_decoded(s: Column) -> Column:
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_text(s: Column) -> Column:
    """A page as plain text: scripts and styles gone, tags a space, entities decoded."""
    bare = F.regexp_replace(s, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(entities_decoded(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


#: German month names.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


def printed_dates(day: Column) -> Column:
    """The three ways in which a page may print a date."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), name, F.lit(" "), F.year(day).cast("string")))


def newest_date(plain: Column) -> Column:
    """The latest of all dates that a text prints, in any of the three ways."""
    iso = F.transform(F.regexp_extract_all(plain, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    dotted = F.transform(F.regexp_extract_all(plain, F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1)), lambda x: F.try_to_date(x, "dd.MM.yyyy"))
    names = "|".join(MONTHS)
    long = F.transform(
        F.regexp_extract_all(plain, F.lit(rf"(\d{{1,2}}\. (?:{names}) \d{{4}})"), F.lit(1)),
        lambda x: F.try_to_date(
            F.concat_ws("-", F.element_at(F.split(x, " "), 3), F.array_position(F.array(*map(F.lit, MONTHS)), F.element_at(F.split(x, " "), 2)).cast("string"), F.replace(F.element_at(F.split(x, " "), 1), F.lit("."), F.lit(""))),
            "yyyy-M-d",
        ),
    )
    return F.array_max(F.concat(iso, dotted, long))


def spec_parts(s: Column) -> Column:
    """'provider:model@endpoint' as a struct; without a provider the whole is the model."""
    return F.struct(
        F.nullif(F.regexp_extract(s, r"^([a-z0-9_]+):", 1), F.lit("")).alias("provider"),
        F.regexp_extract(s, r"^(?:[a-z0-9_]+:)?([^@]*)", 1).alias("model"),
        F.nullif(F.regexp_extract(s, r"@(.*)$", 1), F.lit("")).alias("endpoint"),
    )


def query_pairs(url: Column) -> Column:
    """The query string as an array of (k, v), order and repeats kept."""
    raw = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), url_decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))


def with_param(pairs: Column, key: str, value: Column) -> Column:
    """Every pair of the key removed and one added at the end."""
    left = F.filter(pairs, lambda p: p["k"] != key)
    return F.concat(left, F.array(F.struct(F.lit(key).alias("k"), value.alias("v"))))


def query_string(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), F.url_encode(F.coalesce(p["v"], F.lit(""))))), "&")


def link(url: Column) -> Column:
    """Quotes and brackets percent-encoded so that a link stands inside markup; null becomes empty."""
    out = F.coalesce(url, F.lit(""))
    for a, b in (('"', "%22"), ("[", "%5B"), ("]", "%5D")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cut(s: Column, width: int) -> Column:
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s)
