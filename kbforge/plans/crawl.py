"""From seeds and search hits to question-answer records: the crawl, bodies to text, judgements, failures, synthesis, counters.

Model replies come as columns or tables, so that the plans run with any service (connectors.ask_json) and without one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.config import Config
from kbforge.functions import text as X
from kbforge.functions.urls import content_route, domain_allowed, url_norm
from kbforge.operators import chunk, crawl, dedup, qa
from kbforge.scratch import written
from kbforge.sources import charset, html, office

VERDICT = "struct<relevant:boolean,useful:boolean,category:string,reason:string>"
SUPPORTED = ("html", "pdf", "docx", "xlsx")


def verdict(reply: Column) -> Column:
    """The judge's reply as a struct; anything that is no JSON object of this form gives nulls."""
    return F.from_json(reply, VERDICT)


def relevant_urls(frontier: DataFrame, reply: Column, seed: Column) -> DataFrame:
    """Frontier rows that the URL judge calls relevant; seeds pass unjudged, a missing verdict is a no."""
    return frontier.where(seed.eqNullSafe(F.lit(True)) | verdict(reply)["relevant"].eqNullSafe(F.lit(True)))


def routed(fetched: DataFrame) -> DataFrame:
    """Fetched rows (url, final_url, content_type, body, ...) with `route`, and `failure` where they can't be read."""
    address = F.coalesce("final_url", "url")
    route = F.when(F.col("body").isNull(), "fetch_failed").otherwise(content_route(address, F.col("content_type")))
    out = fetched.withColumn("route", route).withColumn("url", url_norm(address))
    return out.withColumn("failure", F.when(~F.col("route").isin(*SUPPORTED), F.col("route")))


def decoded(rows: DataFrame) -> DataFrame:
    """Routed rows with `text` and `charset` of HTML bodies; nulls for other routes."""
    of_html = F.when(F.col("route") == "html", F.col("body"))
    return rows.withColumn("_d", charset.decoded(of_html, F.col("content_type"))).select(*rows.columns, F.col("_d.text").alias("text"), F.col("_d.charset").alias("charset"))


def extracted(rows: DataFrame, domains: tuple[str, ...] = (), cap: int = html.LINKS) -> DataFrame:
    """Decoded rows with title, content and links(url, anchor, from_url), without their bodies and texts. A body that can't be parsed has
    <route>_parse_failed as its failure, and no title or content. A missing content type gives way to the route's own."""
    own = [c for c in rows.columns if c not in ("body", "text", "content_type", "failure")]
    page = html.html_extract(domains, cap)(F.when(F.col("route") == "html", F.col("text")), F.col("url"))
    files = F.col("route").isin("pdf", "docx", "xlsx")
    out = rows.withColumn("_h", page).withColumn("_o", office.office_extract(F.col("route"), F.col("url"), F.when(files, F.col("body"))))
    is_html = F.col("route") == "html"
    kind = F.coalesce(F.nullif(F.lower("content_type"), F.lit("")), F.when(is_html, "text/html").when(files, F.col("route")), F.lit(""))
    failure = F.coalesce("failure", F.when(files & F.col("_o.content").isNull(), F.concat("route", F.lit("_parse_failed"))))
    links = F.coalesce(F.when(is_html, F.col("_h.links")), F.array())
    return out.select(*own, kind.alias("content_type"), failure.alias("failure"), F.when(is_html, F.col("_h.title")).otherwise(F.col("_o.title")).alias("title"), F.when(is_html, F.col("_h.content")).otherwise(F.col("_o.content")).alias("content"), links.alias("links"))


def frontier(seeds: DataFrame, hits: DataFrame | None = None, domains: tuple[str, ...] = ()) -> DataFrame:
    """seeds(ord, url) and search hits(ord, url, title, snippet) to the first queue (url, title, snippet, source_type, ord): normalized URLs
    within the domains, each once, seeds before hits."""
    rows = seeds.select(F.lit(0).alias("_s"), F.col("ord").alias("_o"), "url", F.lit("Seed URL").alias("title"), F.lit("").alias("snippet"), F.lit("seed").alias("source_type"))
    if hits is not None:
        rows = rows.unionByName(hits.select(F.lit(1).alias("_s"), F.col("ord").alias("_o"), "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.lit("search").alias("source_type")))
    rows = rows.withColumn("url", url_norm(F.col("url"))).where(F.col("url") != "").where(domain_allowed(F.col("url"), domains))
    return dedup.keep_first(rows.withColumn("ord", F.struct("_s", "_o")).drop("_s", "_o"), "url", "ord")


def crawled(queue: DataFrame, fetch: Callable[[DataFrame], DataFrame], domains: tuple[str, ...] = (), config: Config = Config(), history: DataFrame | None = None) -> DataFrame:
    """A breadth-first crawl from a frontier: rows (ord, asked, url, depth, frontier_title, snippet, crawl_source, content_type, title, content,
    failure, ...) in fetch order. fetch takes rows (url) and returns (url, final_url, content_type, body, ...), a null body where it
    failed. URLs of history(url) are passed over. Pages that were read count towards max_pages; links of pages at max_depth aren't followed.
    A child is named after the link that found it first."""
    tables: list[DataFrame] = []

    def level(urls: DataFrame) -> DataFrame:
        rows = fetch(urls.select("url")).withColumn("asked", F.col("url"))
        got = extracted(decoded(routed(rows)), domains)
        if domains:
            got = got.withColumn("links", F.filter("links", lambda x: domain_allowed(x["url"], domains)))
        tables.append(written(got, "crawl-pages"))
        read = F.col("failure").isNull() | F.col("failure").endswith("_parse_failed")
        return tables[-1].select(F.col("asked").alias("url"), read.alias("ok"), F.transform("links", lambda x: x["url"]).alias("links"))

    order = crawl.bfs_crawl(queue.select("url", "ord"), level, config.max_depth, config.max_pages, history)
    if not tables:
        level(queue.where("false"))
    pages = tables[0]
    for more in tables[1:]:
        pages = pages.unionByName(more)
    pages = written(order.select(F.col("position").alias("ord"), F.col("url").alias("asked"), "depth", F.col("ok").alias("read")).join(pages, "asked"), "crawl-pages")
    found = pages.where(F.col("read") & (F.col("depth") < config.max_depth)).select("ord", F.posexplode("links").alias("i", "link"))
    by = found.groupBy(F.col("link.url").alias("asked")).agg(F.min(F.struct("ord", "i", F.col("link.anchor").alias("anchor"), F.col("link.from_url").alias("from_url"))).alias("by"))
    first = queue.select(F.col("url").alias("asked"), F.col("title").alias("_t"), F.col("snippet").alias("_s"), F.col("source_type").alias("_k"))
    rows = pages.drop("read", "links").join(first, "asked", "left").join(by, "asked", "left")
    seed = F.col("_k").isNotNull()
    return rows.select(
        *[c for c in rows.columns if c not in ("_t", "_s", "_k", "by")],
        F.when(seed, F.col("_t")).otherwise(F.col("by.anchor")).alias("frontier_title"),
        F.when(seed, F.col("_s")).otherwise(F.concat(F.lit("discovered from "), "by.from_url")).alias("snippet"),
        F.when(seed, F.col("_k")).otherwise(F.lit("site_discovery")).alias("crawl_source"),
    )


def judged(pages: DataFrame, useful: Column, category: Column, reason: Column, order: str = "ord", history: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Pages (ord, url, title, frontier_title, content) with title, content_hash, status, ai_category, ai_reason.

    status: content_too_short; duplicate_content (the hash was accepted before, or is in history(content_hash)); ai_content_irrelevant;
    kept. A null content is empty. Titles fall back to the frontier's, then to the URL; page_title is the page's own, if it has one. A category is `other` where none is given."""
    rows = pages.withColumns({
        "content": F.coalesce("content", F.lit("")), "title": X.pick_first(F.col("title"), F.col("frontier_title"), F.col("url")),
        "page_title": X.pick_first(F.col("title")),
        "_useful": useful, "ai_category": F.coalesce(category, F.lit("other")), "ai_reason": F.coalesce(reason, F.lit("")),
    })
    rows = rows.withColumn("content_hash", X.content_hash(F.col("content")))
    long = F.length("content") >= config.min_content
    short = rows.where(~long).withColumn("status", F.lit("content_too_short"))
    return dedup.accepted_first(rows.where(long), "content_hash", order, F.col("_useful"), history).unionByName(short).drop("_useful")


def failures(pages: DataFrame, order: str = "ord", history: DataFrame | None = None) -> DataFrame:
    """The log rows (ord, url, reason, title, content_hash, length, reason_detail) of judged pages, once per normalized URL and reason."""
    only = lambda status, c: F.when(F.col("status") == status, c)
    rows = pages.where("status <> 'kept'").select(
        order, url_norm(F.col("url")).alias("url"), F.col("status").alias("reason"), "title", only("duplicate_content", F.col("content_hash")).alias("content_hash"),
        only("content_too_short", F.length("content")).alias("length"), only("ai_content_irrelevant", F.col("ai_reason")).alias("reason_detail"),
    )
    return dedup.failure_log(rows, order, history)


def fetch_failures(pages: DataFrame, order: str = "ord", history: DataFrame | None = None) -> DataFrame:
    """The log rows (ord, url, reason, content_type, error) of crawled pages that were not fetched, are of no type that can be read, or could not be parsed."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    kind = F.when(F.col("failure").startswith("unsupported"), F.col("content_type"))
    rows = pages.where("failure IS NOT NULL").select(order, url_norm(F.col("url")).alias("url"), F.col("failure").alias("reason"), kind.alias("content_type"), error.alias("error"))
    return dedup.failure_log(rows, order, history)


#: What a record says of its page, where that is known.
_PROVENANCE = ("content_type", "crawl_source")


def raw_documents(pages: DataFrame, order: str = "ord") -> DataFrame:
    """Records of the kept pages; content_type, crawl_source and crawl_depth where the pages have them."""
    more = [F.coalesce(c, F.lit("unknown" if c == "crawl_source" else "")).alias(c) for c in _PROVENANCE if c in pages.columns]
    more += [F.coalesce("depth", F.lit(0)).alias("crawl_depth")] if "depth" in pages.columns else []
    return pages.where("status = 'kept'").select(order, X.make_id(F.col("url")).alias("doc_id"), "url", "title", "content", "content_hash", F.length("content").alias("content_length"), "ai_category", "ai_reason", *more)


def chunked(documents: DataFrame, order: str = "ord", config: Config = Config()) -> DataFrame:
    """Rows (ord, chunk_id, chunk) of raw documents."""
    return chunk.chunks(documents, order, "content", config.chunk_size, config.chunk_overlap, config.min_chunk)


def synthesized(documents: DataFrame, replies: DataFrame, order: str = "ord", known: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Documents and the model's replies(ord, chunk_id, reply) to records; known(id) are questions of earlier runs."""
    chunks = chunked(documents, order, config).join(documents.select(order, "doc_id", "url", "title", "ai_category"), order)
    return qa.synthesized(chunks.join(replies, [order, "chunk_id"]), order, known)


@dataclass
class Crawl:
    """What a run leaves: pages with their status, the log, documents and records, and one row of counters."""

    pages: DataFrame
    failures: DataFrame
    documents: DataFrame
    records: DataFrame
    summary: DataFrame


def run(
    queue: DataFrame, fetch: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], synthesize: Callable[[DataFrame], DataFrame],
    domains: tuple[str, ...] = (), config: Config = Config(), history: dict[str, DataFrame] | None = None,
) -> Crawl:
    """A whole run. judge takes pages and returns (ord, reply), synthesize takes rows (ord, chunk_id, title, url, ai_category, chunk) and returns (ord,
    chunk_id, reply); history has the key tables of qa.load_state and `failures` (qa.load_failures)."""
    known = history or {}
    pages = crawled(queue, fetch, domains, config, known.get("urls"))
    read = pages.where("failure IS NULL OR endswith(failure, '_parse_failed')")
    replies = judge(read).select("ord", verdict(F.col("reply")).alias("_v"))
    done = judged(read.join(replies, "ord", "left"), F.col("_v.useful"), F.col("_v.category"), F.col("_v.reason"), history=known.get("content_hashes"), config=config).drop("_v")
    done = written(done, "crawl-judged")
    documents = written(raw_documents(done), "crawl-documents")
    chunks = chunked(documents, config=config).join(documents.select("ord", "title", "url", "ai_category"), "ord")
    records = written(synthesized(documents, synthesize(chunks), known=known.get("questions"), config=config), "crawl-records")
    log = failures(done, history=known.get("failures")).unionByName(fetch_failures(pages, history=known.get("failures")), allowMissingColumns=True)
    return Crawl(done, log, documents, records, qa.crawl_summary(done, records=records, discovered=pages.select("asked")))
