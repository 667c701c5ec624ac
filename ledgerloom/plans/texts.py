"""Documents and pages: trimming, duplicates, rows out of HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, long_texts, trimming
from ..sources import html
from ..sources.files import payloads as built
from .registry import ORACLE_SQL, query
from .views import table

#: Anchors that invented prose has here and there.
ANCHORS = "pathetic|benefit|token|example|license"
_DOCS = rf"""docs AS (SELECT doc_id, text AS whole, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM docs),
hits AS (SELECT *, regexp_matches(lower(replace(line, 'ß', 'ss')), '{ANCHORS}') AS hit FROM lines)"""


def _trimmed(context: int, name: str) -> str:
    return f"""{name}_k AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) = 1 AS keep FROM hits),
{name}_g AS (SELECT *, CASE WHEN keep THEN line WHEN i = 1 OR lag(keep) OVER (PARTITION BY doc_id ORDER BY i) THEN '[…]' END AS o FROM {name}_k),
{name} AS (SELECT doc_id, coalesce(string_agg(o, chr(10) ORDER BY i) FILTER (o IS NOT NULL), '') AS {name} FROM {name}_g GROUP BY doc_id)"""


@query(f"WITH {_DOCS}, {_trimmed(4, 'trimmed')} SELECT doc_id, trimmed FROM trimmed")
def trim_window(spark, sf):
    return table(spark, sf, "documents").select("doc_id", trimming.window_trim(trimming.lines(F.col("text")), ANCHORS).alias("trimmed"))


_SECTIONS = """sec AS (SELECT doc_id, CASE WHEN hit1 THEN whole ELSE '[…]' END AS sec FROM (SELECT doc_id, array_to_string(ls, chr(10)) AS whole, regexp_matches(lower(replace(array_to_string(ls, chr(10)), 'ß', 'ss')), 'A_N_C') AS hit1 FROM docs))""".replace("A_N_C", ANCHORS)


@query(f"WITH {_DOCS}, {_SECTIONS} SELECT doc_id, sec AS trimmed FROM sec")
def trim_sections(spark, sf):
    return table(spark, sf, "documents").select("doc_id", trimming.section_trim(F.col("text"), ANCHORS).alias("trimmed"))


_CHOICE = """CASE WHEN length({w}) >= f AND length(sec) >= f THEN CASE WHEN length({w}) <= length(sec) THEN {w} ELSE sec END WHEN length({w}) >= f THEN {w} WHEN length(sec) >= f THEN sec
WHEN regexp_matches(lower(replace(whole, 'ß', 'ss')), 'A_N_C') THEN CASE WHEN length({w}) <= length(sec) THEN {w} ELSE sec END ELSE whole END""".replace("A_N_C", ANCHORS)


@query(f"WITH {_DOCS}, {_trimmed(4, 'w4')}, {_SECTIONS} SELECT doc_id, {_CHOICE.format(w='w4')} AS trimmed FROM (SELECT *, length(whole) * 0.15 AS f FROM docs JOIN w4 USING (doc_id) JOIN sec USING (doc_id))")
def trim_choice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", trimming.trim(F.col("text"), ANCHORS).alias("trimmed"))


_BUDGET = 300


@query(f"""WITH {_DOCS}, {", ".join(_trimmed(c, f"w{c}") for c in (1, 2, 3, 4))}, {_SECTIONS},
c AS (SELECT doc_id, {", ".join(f"{_CHOICE.format(w=f'w{n}')} AS c{n}" for n in (1, 2, 3, 4))} FROM (SELECT *, length(whole) * 0.15 AS f FROM docs JOIN w1 USING (doc_id) JOIN w2 USING (doc_id) JOIN w3 USING (doc_id) JOIN w4 USING (doc_id) JOIN sec USING (doc_id)))
SELECT doc_id, CASE WHEN length(c4) <= {_BUDGET} THEN c4 WHEN length(c3) <= {_BUDGET} THEN c3 WHEN length(c2) <= {_BUDGET} THEN c2 ELSE c1 END AS trimmed FROM c""")
def trim_budget(spark, sf):
    return table(spark, sf, "documents").select("doc_id", trimming.trim_to_budget(F.col("text"), ANCHORS, _BUDGET).alias("trimmed"))


#: Lines of a block where texts are trimmed in pieces: few, as most of these texts are short.
_LINES = 8


@query(ORACLE_SQL["trim_choice"])
def trim_in_blocks(spark, sf):
    """As ``trim_choice``, the lines of one text dealt to many tasks."""
    pieces = long_texts.trim_pieces(table(spark, sf, "documents"), "doc_id", "text", ANCHORS, size=_LINES)
    return long_texts.put_together(pieces, "doc_id").withColumnRenamed("text", "trimmed")


@query(ORACLE_SQL["trim_budget"])
def trim_budget_in_blocks(spark, sf):
    pieces = long_texts.trim_pieces(table(spark, sf, "documents"), "doc_id", "text", ANCHORS, budget=_BUDGET, size=_LINES)
    return long_texts.put_together(pieces, "doc_id").withColumnRenamed("text", "trimmed")


@query(f"WITH {_DOCS}, {_trimmed(4, 'w4')} SELECT doc_id, length(whole) AS chars, length(w4) AS kept, length(w4) * 100.0::DOUBLE / greatest(length(whole), 1) AS kept_pct, length(w4) // 4 AS tokens FROM docs JOIN w4 USING (doc_id)")
def trim_stats(spark, sf):
    cut = trimming.window_trim(trimming.lines(F.col("text")), ANCHORS)
    return table(spark, sf, "documents").select("doc_id", trimming.sizes(F.col("text"), cut).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, replace(text, 'xx-' || chr(10) || 'yy', 'xxyy') AS joined FROM (SELECT doc_id, text || ' xx-' || chr(10) || 'yy Zz-' || chr(10) || 'Aa' AS text FROM documents)")
def dehyphenate(spark, sf):
    split = F.concat(F.col("text"), F.lit(" xx-\nyy Zz-\nAa"))
    return table(spark, sf, "documents").select("doc_id", text.dehyphenated(split).alias("joined"))


@query("""SELECT sha256(t) AS content_sha256, n, doc_id FROM (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS n FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)) WHERE t <> '' AND n > 1""")
def dedup_content(spark, sf):
    return dedup.duplicate_contents(table(spark, sf, "documents"), "text", "doc_id").withColumnRenamed("place", "doc_id")


@query("""WITH b AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS block FROM (SELECT page_id, string_split(html, '<li>') AS l FROM pages)),
f AS (SELECT page_id, i, regexp_extract(block, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(block, '>([^<]*)</a>', 1)) AS label FROM b WHERE i > 1)
SELECT page_id, href, label, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position FROM f WHERE href <> '' AND label <> ''""")
def html_rows(spark, sf):
    found = html.blocks(table(spark, sf, "pages"), "page_id", "html", "<li>")
    return html.rows(found, "page_id", {"href": r'href="([^"]*)"', "label": r">([^<]*)</a>"}, ["href", "label"])


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&euro;', '€'), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM pages""")
def html_plain(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("plain"))


@query("SELECT page_id, 'panel:' || left(sha256(string_agg(DISTINCT u, chr(10) ORDER BY u)), 16) AS bundle FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY page_id")
def link_bundles(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    return html.bundles(links, "page_id", "url").select("page_id", "bundle")


@query("""WITH b AS (SELECT page_id, len(string_split(html, '<li>')) - 1 AS n_rows, len(string_split(html, '<p>')) - 1 AS n_signals FROM pages) SELECT * FROM b WHERE n_rows < n_signals""")
def undercounts(spark, sf):
    pages = table(spark, sf, "pages")
    return html.undercount(html.blocks(pages, "page_id", "html", "<li>"), pages, "page_id", "html", "<p>")


@query("SELECT conv_id, '# reply' || string_agg(chr(10) || chr(10) || '=== ' || role || ' ===' || chr(10) || t, '' ORDER BY role, t) AS payload FROM (SELECT conv_id, role, text AS t FROM conversations) GROUP BY conv_id")
def payloads(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id"), F.col("role").alias("doctype"), "text")
    return built(turns, "# reply", "conv_id")
