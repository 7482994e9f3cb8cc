"""Document identity: duplicates, versions, identifiers and the sources that they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import removed, written

# Hosts and URL parts that identifiers are read from or rid of.
ARXIV_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")
DOI_HOSTS = ("doi.org", "dx.doi.org", "www.doi.org")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid", "yclid", "msclkid")
STRONG = ("arxiv", "doi", "isbn", "pmid")


def content_duplicates(docs: DataFrame) -> DataFrame:
    """Documents whose content another id has too: the twin is the smallest id with that content."""
    first = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    twins = first.groupBy("sha").agg(F.min("doc_id").alias("twin_id"))  # partial sums before the shuffle, so a hot content is folded early
    return first.join(twins, "sha").where("doc_id <> twin_id").select("doc_id", "twin_id", "sha")


def stage_versions(live: DataFrame, versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """New version rows of an ingest batch.

    A document without versions gets version 1 from its live content first; content that the document ever had
    (versions or live) is a duplicate and stages nothing; others get the numbers after the highest.
    """
    sha = F.sha2(F.col("text").cast("binary"), 256)
    known = versions.select("doc_id", "version", "sha").union(live.join(versions.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(1).cast("long"), sha))
    backfill = live.join(versions.select("doc_id").distinct(), "doc_id", "left_anti").join(incoming.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(1).cast("long").alias("version"), sha.alias("sha"), F.lit("backfill").alias("why"))
    ever = known.select("doc_id", "sha").union(live.select("doc_id", sha)).distinct()
    first = incoming.withColumn("sha", sha).groupBy("doc_id", "sha").agg(F.min("batch_order").alias("batch_order"))
    new = first.join(ever, ["doc_id", "sha"], "left_anti")
    top = known.groupBy("doc_id").agg(F.max("version").alias("top"))
    numbered = new.join(top, "doc_id", "left").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("batch_order")))
    return backfill.union(numbered.select("doc_id", (F.coalesce("top", F.lit(0)) + F.col("k")).cast("long"), "sha", F.lit("staged")))


def ingest_decision(incoming: DataFrame, live: DataFrame, resolutions: DataFrame, linked: DataFrame) -> DataFrame:
    """Decision for each incoming document, in order: duplicate, conflict reject, redirect to the earliest linked
    document of the same source, stage of a known id (accepted at once if authenticated and unflagged), else live."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    twins = live.groupBy(sha.alias("sha")).agg(F.min("doc_id").alias("twin_id"))
    known = live.select("doc_id").distinct().withColumn("is_known", F.lit(True))
    earliest = linked.groupBy("source_id").agg(F.min_by("doc_id", F.struct("linked_order", "doc_id")).alias("earliest"))
    j = incoming.withColumn("sha", sha).join(twins, "sha", "left").join(resolutions, "doc_id", "left").join(earliest, "source_id", "left").join(known, "doc_id", "left")
    decision = (
        F.when(F.col("twin_id").isNotNull(), "duplicate").when(F.col("status") == "CONFLICT", "reject")
        .when((F.col("status") == "SAME_SOURCE") & F.col("earliest").isNotNull() & (F.col("earliest") != F.col("doc_id")), "redirect")
        .when(F.col("is_known") & F.col("authenticated") & (F.col("n_flags") == 0), "stage_accepted").when(F.col("is_known"), "stage").otherwise("live")
    )
    return j.select("doc_id", decision.alias("decision"), F.when(decision == "duplicate", F.col("twin_id")).when(decision == "redirect", F.col("earliest")).alias("target_id"))


def version_history(versions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Versions in order with their state: the latest accepted one is live, other accepted ones are past, the rest pending."""
    j = versions.join(accepted.select("doc_id", "version", "accepted_by"), ["doc_id", "version"], "left")
    last = F.max(F.when(F.col("accepted_by").isNotNull(), F.col("version"))).over(Window.partitionBy("doc_id"))
    state = F.when(F.col("accepted_by").isNull(), "pending").when(F.col("version") == last, "live").otherwise("past")
    return j.select("doc_id", "version", state.alias("state"), "accepted_by")


def version_change_summary(pairs: DataFrame) -> DataFrame:
    """Lines added, removed and kept between two texts, as multisets; similarity 2 * kept / total."""

    def lines(c: str) -> DataFrame:
        rows = pairs.select("doc_id", F.explode(F.split(F.col(c), "\n")).alias("line"))
        return rows.groupBy("doc_id", "line").agg(F.count("*").alias(f"n_{c}"))

    j = lines("old_text").join(lines("new_text"), ["doc_id", "line"], "full_outer").fillna(0, ["n_old_text", "n_new_text"])
    kept = F.sum(F.least("n_old_text", "n_new_text"))
    return j.groupBy("doc_id").agg(
        (F.sum("n_new_text") - kept).alias("added"), (F.sum("n_old_text") - kept).alias("removed"), kept.alias("kept"),
        F.round(2.0 * kept / (F.sum("n_old_text") + F.sum("n_new_text")), 6).alias("similarity"),
    )


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "(?i)^https?://([^/?#:]+)", 1))


def normalise_arxiv(raw: Column) -> Column:
    v = F.trim(raw)
    path = F.regexp_extract(v, "(?i)^https?://[^/]+/(?:abs|pdf)/([^?#]+)", 1)
    v = F.when(_host(v).isin(*ARXIV_HOSTS) & (path != ""), path).otherwise(v)
    for pattern in ("(?i)^arxiv:\\s*", "(?i)\\.pdf$", "(?i)v[0-9]+$"):
        v = F.regexp_replace(v, pattern, "")
    return F.when(v.rlike("^[0-9]{4}\\.[0-9]{4,5}$"), v).when(F.lower(v).rlike("^[a-z-]+(\\.[a-z]{2})?/[0-9]{7}$"), F.lower(v))


def normalise_doi(raw: Column) -> Column:
    v = F.regexp_replace(F.trim(raw), "(?i)^doi:\\s*", "")
    path = F.regexp_extract(v, "(?i)^https?://[^/]+/([^?#]+)", 1)
    v = F.when(_host(v).isin(*DOI_HOSTS) & (path != ""), path).otherwise(v)
    v = F.regexp_replace(F.lower(F.trim(v)), "[.,;:)\\]}>\"']+$", "")
    return F.when(v.rlike("^10\\.[0-9]{4,9}/[^\\s]+$"), v)


def _digit_sum(v: Column, n: int, weight) -> Column:
    total = F.lit(0)
    for i in range(n):
        c = F.substring(v, i + 1, 1)
        total = total + weight(i) * F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))
    return total


def _check13(v: Column) -> Column:
    return F.pmod(10 - _digit_sum(v, 12, lambda i: 1 if i % 2 == 0 else 3) % 10, F.lit(10)).cast("string")


def normalise_isbn(raw: Column) -> Column:
    v = F.upper(F.regexp_replace(F.regexp_replace(F.trim(raw), "(?i)^isbn(-1[03])?:?\\s*", ""), "[\\s-]", ""))
    core = F.concat(F.lit("978"), F.substring(v, 1, 9))
    ten = v.rlike("^[0-9]{9}[0-9X]$")
    good10 = F.when(ten, _digit_sum(v, 10, lambda i: 10 - i) % 11 == 0)
    thirteen = v.rlike("^[0-9]{13}$")
    return F.when(good10, F.concat(core, _check13(core))).when(F.when(thirteen, F.substring(v, 13, 1) == _check13(v)), v)


def normalise_pmid(raw: Column) -> Column:
    v = F.regexp_replace(F.trim(raw), "(?i)^pmid:?\\s*", "")
    return F.when(v.rlike("^[0-9]{1,9}$") & v.rlike("[1-9]"), F.regexp_replace(v, "^0+", ""))


def normalise_url(raw: Column) -> Column:
    """Scheme and host in lower case, default ports, index files, tracking parameters, fragment and last slash gone, query sorted."""
    v = F.trim(raw)
    scheme = F.lower(F.regexp_extract(v, "^([A-Za-z]+)://", 1))
    rest = "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\\?([^#]*))?"
    host, port, path, query = F.lower(F.regexp_extract(v, rest, 1)), F.regexp_extract(v, rest, 2), F.regexp_extract(v, rest, 3), F.regexp_extract(v, rest, 4)
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "(?i)/index\\.html?$", "/")
    path = F.when(F.length(path) > 1, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    query = F.array_join(F.array_sort(kept), "&")
    url = F.concat(scheme, F.lit("://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), url)


def normalise_identifier(kind: Column, raw: Column) -> Column:
    """Normalised value by type; null where the value is not valid for it."""
    return (
        F.when(kind == "arxiv", normalise_arxiv(raw)).when(kind == "doi", normalise_doi(raw)).when(kind == "isbn", normalise_isbn(raw))
        .when(kind == "pmid", normalise_pmid(raw)).when(kind == "url", normalise_url(raw)).when(kind == "other", F.nullif(F.trim(raw), F.lit("")))
    )


def normalise_identifiers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value_norm", normalise_identifier(F.col("type"), F.col("value_raw")))


def extract_identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, type, value_norm, is_canonical) of provenance and metadata JSON.

    Strong identifiers are canonical only in trusted documents whose provenance says so; a value that is not valid
    becomes an ``other``; of equal ones the canonical wins.
    """
    p = lambda c, k: F.get_json_object(c, f"$.{k}")
    original = F.col("trusted") & (p("provenance", "identifier_origin") == "original")
    pairs = F.array(*[F.struct(F.lit(kind).alias("type"), p("provenance", key).alias("value_raw"), (original if kind in STRONG else F.lit(False)).alias("canonical")) for kind, key in (("doi", "doi"), ("arxiv", "arxiv_id"), ("isbn", "isbn"), ("url", "source_url"))],
                    F.struct(F.lit("doi").alias("type"), p("metadata", "DOI").alias("value_raw"), F.col("trusted").alias("canonical")))
    rows = docs.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*").where("value_raw IS NOT NULL")
    norm = normalise_identifier(F.col("type"), F.col("value_raw"))
    rows = rows.withColumn("norm", norm).select(
        "doc_id", F.when(F.col("norm").isNull(), "other").otherwise(F.col("type")).alias("type"), F.coalesce("norm", F.nullif(F.trim("value_raw"), F.lit(""))).alias("value_norm"), (F.col("norm").isNotNull() & F.coalesce("canonical", F.lit(False))).alias("canonical")
    )
    return rows.where("value_norm IS NOT NULL").groupBy("doc_id", "type", "value_norm").agg(F.max("canonical").alias("is_canonical"))


def resolve_sources(new: DataFrame, links: DataFrame) -> DataFrame:
    """NEW_SOURCE, SAME_SOURCE, REVIEW or CONFLICT for each document.

    ``new`` and ``links`` have (doc_id or source_id, type, value_norm, is_canonical).  A canonical match decides; two
    canonical values of one type, matches to several sources, or a matched source with another canonical value conflict.
    Other matches lead to review, but not to sources whose canonical ids differ.
    """
    new, links = new.where("type <> 'other'"), links.where("type <> 'other'")
    canon_new = new.where("is_canonical").groupBy("doc_id", "type").agg(F.min("value_norm").alias("canon"), F.count_distinct("value_norm").alias("n"))
    double = canon_new.where("n > 1").select("doc_id").distinct().withColumn("double", F.lit(True))
    source_canon = links.where("is_canonical").select("source_id", "type", F.col("value_norm").alias("theirs")).distinct()
    strong = new.where("is_canonical").join(links.where("is_canonical").select("source_id", "type", "value_norm").distinct(), ["type", "value_norm"]).groupBy("doc_id").agg(F.count_distinct("source_id").alias("n_strong"), F.min("source_id").alias("source_id"))
    weak = new.select("doc_id", "type", "value_norm").join(links.select("source_id", "type", "value_norm").distinct(), ["type", "value_norm"]).select("doc_id", "source_id").distinct()
    # only pairs that share a value can be wrong, in review or ignored, so only their canonical values are compared
    differs = weak.join(canon_new, "doc_id").join(source_canon, ["source_id", "type"]).where("theirs <> canon").select("doc_id", "source_id").distinct()
    wrong = strong.join(differs, ["doc_id", "source_id"], "left_semi").select("doc_id").withColumn("wrong", F.lit(True))
    review = weak.join(differs, ["doc_id", "source_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_candidates"))
    ignored = weak.join(differs, ["doc_id", "source_id"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_ignored"))
    j = new.select("doc_id").distinct().join(double, "doc_id", "left").join(strong, "doc_id", "left").join(wrong, "doc_id", "left").join(review, "doc_id", "left").join(ignored, "doc_id", "left")
    status = F.when(F.col("double"), "CONFLICT").when(F.col("n_strong") > 1, "CONFLICT").when(F.col("wrong"), "CONFLICT").when(F.col("n_strong") == 1, "SAME_SOURCE").when(F.col("n_candidates") > 0, "REVIEW").otherwise("NEW_SOURCE")
    return j.select("doc_id", status.alias("status"), F.when(status == "SAME_SOURCE", F.col("source_id")).alias("source_id"), F.coalesce("n_ignored", F.lit(0)).alias("n_ignored"))


def source_components(identifiers: DataFrame) -> DataFrame:
    """(doc_id, root): documents that share a canonical identifier are one source, transitively; the root is the smallest id.

    Minimum labels travel over (document, identifier) links; each round also follows its label's label, so the rounds
    grow with the logarithm of the longest chain.  Each round is written to the working folder, which cuts lineage, and
    the one before is deleted.  Labels never grow, so an unchanged sum means that none changed.
    """
    edges = written(identifiers.where("is_canonical").select("doc_id", F.concat_ws(":", "type", "value_norm").alias("key")).distinct(), "components-edges")
    labels, before = edges.select("doc_id", F.col("doc_id").alias("root")).distinct(), None
    while True:
        by_key = edges.join(labels, "doc_id").groupBy("key").agg(F.min("root").alias("root"))
        near = edges.join(by_key, "key").groupBy("doc_id").agg(F.min("root").alias("near"))
        jump = near.join(labels.select(F.col("doc_id").alias("near"), F.col("root").alias("far")), "near", "left").select("doc_id", F.least("near", F.coalesce("far", "near")).alias("root"))
        last, labels = labels, written(jump, "components")
        removed(last)
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            removed(edges)
            return labels
        before = now


def canonical_conflicts(links: DataFrame) -> DataFrame:
    """Sources that carry two canonical values of one type."""
    return links.where("is_canonical").groupBy("source_id", "type").agg(F.count_distinct("value_norm").alias("n_values")).where("n_values > 1")


def canonical_counts(links: DataFrame) -> DataFrame:
    """(type, n_links, n_sources): how many canonical links there are of each type, and of how many sources."""
    return links.where("is_canonical").groupBy("type").agg(F.count("*").alias("n_links"), F.count_distinct("source_id").alias("n_sources"))


def source_lookup(links: DataFrame, document_links: DataFrame, given: DataFrame) -> DataFrame:
    """Every link of every source that shares any given identifier, with the source's documents in linked order."""
    hit = links.join(given.select("type", "value_norm").distinct(), ["type", "value_norm"], "left_semi").select("source_id").distinct()
    documents = document_links.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linked_order", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",").alias("documents"))
    return links.join(hit, "source_id", "left_semi").join(documents, "source_id", "left").select("source_id", "type", "value_norm", "documents")
