"""Queries of text preparation, bound to ``documents`` and ``pages`` (with planted marks, so that nothing passes vacuously)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as X
from .registry import Tables, query, source

source("plain_docs", "SELECT doc_id, text FROM {documents} WHERE text IS NOT NULL")
source("marked_docs", """
    SELECT doc_id, '# Title ' || CAST(doc_id AS STRING) || chr(10) || text || chr(10) || '## Part one' || chr(10)
        || CASE WHEN doc_id % 3 = 0 THEN '# Second' || chr(10) || 'Rule A holds. Rule B follows.' || chr(10) ELSE '' END
        || CASE WHEN doc_id % 2 = 0 THEN 'References' || chr(10) || repeat('One more reference. ', CAST(floor(length(text) * (doc_id % 7) / 80) AS INT)) ELSE 'end' END AS text
    FROM {documents}""")
source("fixed_chunks", """
    SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS text
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 500) AS BIGINT))) AS i FROM {marked_docs})""")


def _fixed(t: Tables) -> DataFrame:
    return X.chunk_fixed(t("marked_docs"), 500)


@query("SELECT * FROM {fixed_chunks}")
def chunk_fixed(t: Tables) -> DataFrame:
    return _fixed(t)


@query()
def chunk_recursive(t: Tables) -> DataFrame:
    return X.chunk_recursive(t("plain_docs"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {marked_docs}),
    t AS (SELECT *, CASE WHEN regexp_matches(line, '^# +[^ ]') THEN trim(regexp_replace(line, '^# +', '')) END AS t1, CASE WHEN regexp_matches(line, '^## +[^ ]') THEN trim(regexp_replace(line, '^## +', '')) END AS t2 FROM l),
    s AS (SELECT *, t1 IS NOT NULL OR t2 IS NOT NULL AS head, sum(CASE WHEN t1 IS NOT NULL OR t2 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section,
        last_value(t1 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS h1, count(t1) OVER (PARTITION BY doc_id ORDER BY n) AS g1 FROM t),
    u AS (SELECT *, last_value(t2 IGNORE NULLS) OVER (PARTITION BY doc_id, g1 ORDER BY n) AS h2 FROM s)
    SELECT * FROM (SELECT doc_id, CAST(section AS BIGINT) AS section, max(h1) AS h1, max(h2) AS h2, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), '') AS text FROM u GROUP BY doc_id, section) WHERE trim(text) <> ''""")
def chunk_markdown_headers(t: Tables) -> DataFrame:
    return X.chunk_markdown_headers(t("marked_docs"))


@query("SELECT doc_id, count(*) AS n, round(avg(length(text)), 4) AS mean_length, min(length(text)) AS least, max(length(text)) AS most FROM {fixed_chunks} GROUP BY doc_id")
def chunk_stats(t: Tables) -> DataFrame:
    return X.chunk_stats(_fixed(t))


#: Windows over whole texts; how far they overlap depends on the document.
source("overlapping", """
    SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(1 + i * (500 - doc_id % 300) AS BIGINT), 500) AS text
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / (500 - doc_id % 300)) AS BIGINT))) AS i FROM {documents})""")


def _overlapping(t: Tables) -> DataFrame:
    step = F.lit(500) - F.col("doc_id") % 300
    rows = t("documents").where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / step).cast("long") - 1)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substring("text", (1 + F.col("chunk_index") * step).cast("int"), F.lit(500)).alias("text"))


@query("""
    SELECT doc_id, chunk_index, (SELECT max(k) FROM range(0, least(length(text), length(after)) + 1) r(k) WHERE right(text, k) = left(after, k)) AS overlap
    FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS after FROM {overlapping}) WHERE after IS NOT NULL""")
def chunk_overlap(t: Tables) -> DataFrame:
    return X.chunk_overlap(_overlapping(t))


@query("""
    SELECT doc_id, max(contains(text, 'Rule A holds.') AND contains(text, 'Rule B follows.')) AS intact, min(CASE WHEN contains(text, 'Rule A holds.') THEN chunk_index END) AS first_at, min(CASE WHEN contains(text, 'Rule B follows.') THEN chunk_index END) AS second_at
    FROM {fixed_chunks} GROUP BY doc_id HAVING first_at IS NOT NULL OR second_at IS NOT NULL""")
def rule_intact(t: Tables) -> DataFrame:
    return X.rule_intact(_fixed(t), "Rule A holds.", "Rule B follows.")


@query(r"""
    SELECT doc_id, length(head) > 0 AND length(head) >= 0.5 * length(text) AS is_cut, CASE WHEN length(head) > 0 AND length(head) >= 0.5 * length(text) THEN length(head) ELSE length(text) END AS n_chars
    FROM (SELECT *, regexp_extract(text, '(?s)^(.*\n)[ \t]*(?:References|REFERENCES|Bibliography)[ \t]*(?:\n|$)', 1) AS head FROM {marked_docs})""")
def truncate_references(t: Tables) -> DataFrame:
    return X.truncate_references(t("marked_docs")).select("doc_id", "is_cut", F.length("text").cast("long").alias("n_chars"))


source("controlled", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, ' of ', chr(1)) ELSE text END AS text FROM {documents}")


@query("SELECT doc_id, length(text) - length(replace(text, chr(1), '')) AS n_replaced, md5(replace(text, chr(1), chr(65533))) AS text_md5 FROM {controlled}")
def replace_nul(t: Tables) -> DataFrame:
    return X.replace_nul(t("controlled"), "\x01").select("doc_id", "n_replaced", F.md5("text").alias("text_md5"))


@query("SELECT DISTINCT c.doc_id, c.chunk_index FROM {fixed_chunks} c JOIN {controlled} d ON d.doc_id = c.doc_id WHERE contains(d.text, chr(1))")
def chunks_to_embed_again(t: Tables) -> DataFrame:
    dirty = X.replace_nul(t("controlled"), "\x01").where("n_replaced > 0")
    return _fixed(t).join(dirty.select("doc_id"), "doc_id", "left_semi").select("doc_id", "chunk_index")


source("invisible", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, 'th', 't\u200bh\ufe0e') ELSE text END AS text FROM {documents}")


@query(r"SELECT doc_id, length(text) - length(regexp_replace(text, '[\p{Cf}\p{Co}\x{FE00}-\x{FE0F}]', '', 'g')) AS n_removed, md5(regexp_replace(text, '[\p{Cf}\p{Co}\x{FE00}-\x{FE0F}]', '', 'g')) AS text_md5 FROM {invisible}")
def strip_invisible(t: Tables) -> DataFrame:
    return X.strip_invisible(t("invisible")).select("doc_id", "n_removed", F.md5("text").alias("text_md5"))


@query()
def normalise_text(t: Tables) -> DataFrame:
    return X.normalise_text(t("invisible")).select("doc_id", F.md5("normal").alias("normal_md5"), F.md5("squashed").alias("squashed_md5"))


@query()
def html_visible_text(t: Tables) -> DataFrame:
    return X.html_visible_text(t("pages"))


source("tagged_pages", """
    SELECT page_id, '<meta name="citation_title" content="Paper ' || CAST(page_id AS STRING) || '"><META content="Ada Lovelace" name="citation_author">'
        || CASE WHEN page_id % 2 = 0 THEN '<meta name="citation_author" content="van Beethoven, Ludwig"><meta content="20' || CAST(10 + page_id % 10 AS STRING) || '/05" name="citation_date">' ELSE '' END || html AS html
    FROM {pages}""")
source("page_tags", r"""
    SELECT page_id, name, string_agg(value, '|' ORDER BY n) AS values FROM (
        SELECT page_id, n, lower(regexp_extract(tag, '(?i)name="(citation_[a-z_]+)"', 1)) AS name, regexp_extract(tag, '(?i)content="([^"]*)"', 1) AS value FROM (
            SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta\s[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?i)<meta\s[^>]*>'), 1) AS n FROM {tagged_pages}))
    WHERE name <> '' GROUP BY page_id, name""")


@query("SELECT page_id, name, values FROM {page_tags}")
def html_meta_tags(t: Tables) -> DataFrame:
    return X.html_meta_tags(t("tagged_pages"))


source("authors", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Family' || CAST(doc_id AS STRING) || ', Given' WHEN 1 THEN 'Ada  Lovelace' WHEN 2 THEN 'Ludwig van Beethoven' WHEN 3 THEN 'Plato' ELSE ' ' || substr(lang, 1, 2) || ' de la Cruz ' END AS name FROM {documents}""")


@query("""
    WITH a AS (SELECT doc_id, trim(regexp_replace(name, ' +', ' ', 'g')) AS c FROM {authors}), w AS (SELECT *, string_split(c, ' ') AS ws, contains(c, ',') AS comma FROM a),
    p AS (SELECT *, coalesce((SELECT min(i) FROM range(2, len(ws)) r(i) WHERE lower(ws[i]) IN ('van', 'von', 'der', 'den', 'de', 'del', 'la', 'di', 'da')), len(ws)) AS pos FROM w)
    SELECT doc_id, CASE WHEN c = '' THEN NULL WHEN comma THEN trim(split_part(c, ',', 1)) WHEN len(ws) > 1 THEN array_to_string(ws[pos:len(ws)], ' ') END AS family,
        CASE WHEN c = '' THEN NULL WHEN comma THEN trim(regexp_replace(c, '^[^,]*,', '')) WHEN len(ws) > 1 THEN array_to_string(ws[1:pos - 1], ' ') END AS given, CASE WHEN c <> '' AND NOT comma AND len(ws) = 1 THEN c END AS literal FROM p""")
def split_author_name(t: Tables) -> DataFrame:
    return X.split_author_name(t("authors")).select("doc_id", "family", "given", "literal")


source("dates", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2021' WHEN 1 THEN '2020-' || CAST(1 + doc_id % 12 AS STRING) WHEN 2 THEN '2019/11/' || CAST(1 + doc_id % 28 AS STRING) WHEN 3 THEN 'May 2020' ELSE CAST(NULL AS STRING) END AS date FROM {documents}")


@query(r"""
    SELECT doc_id, nullif(concat_ws('-', nullif(y, ''), CAST(TRY_CAST(m AS INT) AS VARCHAR), CAST(TRY_CAST(d AS INT) AS VARCHAR)), '') AS parts FROM (
        SELECT doc_id, regexp_extract(date, '^([0-9]{4})(?:[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?)?$', 1) AS y, regexp_extract(date, '^([0-9]{4})(?:[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?)?$', 2) AS m,
            regexp_extract(date, '^([0-9]{4})(?:[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?)?$', 3) AS d FROM {dates})""")
def parse_date_parts(t: Tables) -> DataFrame:
    return X.parse_date_parts(t("dates")).select("doc_id", F.array_join(F.col("date_parts").cast("array<string>"), "-").alias("parts"))


source("cited_docs", "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 'Title ' || CAST(n_chars AS STRING) END AS title FROM {documents}")
source("bibliography", "SELECT doc_id, 'Book ' || CAST(doc_id AS STRING) AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Author ' || lang END AS author, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '19' || CAST(70 + doc_id % 30 AS STRING) END AS year FROM {documents} WHERE doc_id % 2 = 1")


@query("""
    SELECT d.doc_id, CASE WHEN t.title IS NOT NULL THEN 'landing' WHEN b.title IS NOT NULL THEN 'bibliography' ELSE 'provenance' END AS kind, coalesce(t.title, b.title, d.title) AS title, coalesce(t.author, b.author) AS author,
        coalesce(nullif(regexp_extract(t.date, '^([0-9]{4})', 1), ''), b.year) AS year,
        CASE WHEN coalesce(t.title, b.title, d.title) IS NULL THEN 'no title' WHEN coalesce(t.author, b.author) IS NULL THEN 'no author' WHEN coalesce(nullif(regexp_extract(t.date, '^([0-9]{4})', 1), ''), b.year) IS NULL THEN 'no year' END AS dropped_because
    FROM {cited_docs} d LEFT JOIN {bibliography} b ON b.doc_id = d.doc_id LEFT JOIN (SELECT page_id, max(CASE WHEN name = 'citation_title' THEN values END) AS title, max(CASE WHEN name = 'citation_author' THEN values END) AS author,
        max(CASE WHEN name = 'citation_date' THEN values END) AS date FROM {page_tags} GROUP BY page_id) t ON t.page_id = d.doc_id""")
def citation_records(t: Tables) -> DataFrame:
    return X.citation_records(t("cited_docs"), X.html_meta_tags(t("tagged_pages")).withColumnRenamed("page_id", "doc_id"), t("bibliography"))


source("rich", "SELECT doc_id, '![img](http://a.example/x.png) see [the site](https://b.example/y) <b>' || text || '</b> https://c.example/z?q=1 end' AS text FROM {documents}")


@query(r"""
    SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]*>', ' ', 'g'), 'https?://[^ \t\n]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), 400) AS text FROM {rich}""")
def strip_markup(t: Tables) -> DataFrame:
    return X.strip_markup(t("rich"))


@query(r"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS sentence_index, s AS sentence FROM (
        SELECT doc_id, trim(s) AS s, n FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), '\n+') AS p FROM {marked_docs}))) WHERE s <> ''""")
def sentence_explode(t: Tables) -> DataFrame:
    return X.sentence_explode(t("marked_docs"), "doc_id")
