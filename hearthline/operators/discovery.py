"""From crawled pages to ranked sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.functions import extract as X
from hearthline.functions import normalize as N

from .shared import cut

#: Signs of a page's text that are scored, and links of a page that are followed.
TEXT_CAP, LINK_CAP = 15_000, 120
DATE = r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"


def page_scores(pages: DataFrame, words: Iterable[str] = keywords.COMMERCIAL, hints: Iterable[str] = keywords.LISTING_HINTS, card: str | None = None, kinds=keywords.SOURCE_KINDS) -> DataFrame:
    """page_id, url, domain, four scores of at most 100, template and kind. words: of the trade; hints: in a listing's address; card: pattern of a listing card, else elements of one of the classes CARDS."""
    text = F.left(X.page_text(F.col("html")), F.lit(TEXT_CAP))
    link = F.transform(X.links(F.col("html")), lambda h: X.resolve_link(F.col("url"), h))
    rows = pages.select("page_id", "url", "html", N.domain(F.col("url")).alias("domain"), text.alias("text"), F.size(F.filter(link, lambda x: X.hint_count(x, hints) > 0)).alias("listed"))
    contacts = F.size(X.all_matches(F.col("text"), X.PHONE)) + F.size(X.all_matches(F.col("text"), X.EMAIL))
    capped = lambda c: F.least(F.lit(100), c).cast("int")
    return rows.select(
        "page_id", "url", "domain", capped(10 * X.hint_count(F.col("text"), words) + 2 * F.col("listed")).alias("relevance"), capped(4 * F.col("listed")).alias("density"), capped(40 * contacts).alias("richness"),
        capped(20 * F.regexp_count("text", F.lit(DATE))).alias("updates"), template_match(F.col("html"), card_count(F.col("html")) if card is None else F.regexp_count("html", F.lit(card))).alias("template"), source_kind(F.col("domain"), F.col("text"), kinds).alias("kind"),
    )


# Classes of listing cards, and the keys of the two templates.
CARDS = ("card", "item", "listing", "offer", "object", "product")
MARKED, GRID = "jsonld_listing", "listing_grid_basic"


def card_count(html: Column, names: Iterable[str] = CARDS) -> Column:
    """Elements whose class list holds one of the names, as whole words in their own case, whatever quotes the list has."""
    lists = F.transform(X.all_matches(html, r"""<[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>"""), lambda tag: F.regexp_extract(tag, r"""(?is)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1))
    return F.size(F.filter(lists, lambda v: F.arrays_overlap(F.split(F.trim(F.regexp_replace(v, "[\"'\\s]+", " ")), " "), F.array(*map(F.lit, names)))))


def _evidence(html: Column, cards: Column) -> tuple[Column, Column]:
    low = F.lower(html)
    marked = F.contains(low, F.lit("application/ld+json")) & (F.contains(low, F.lit("offer")) | F.contains(low, F.lit("realestate")))
    return F.when(marked, 0.85).otherwise(0.0), F.when(cards >= 6, 0.7).when(cards >= 3, 0.5).otherwise(0.0)


def template_match(html: Column, cards: Column) -> Column:
    """How surely a page follows a known template; 0 below the acceptance threshold."""
    best = F.greatest(*_evidence(html, cards))
    return F.when(best >= 0.55, best).otherwise(0.0)


def template_choice(html: Column, cards: Column, known: Iterable[str] = (MARKED, GRID)) -> Column:
    """(template, score): the template that a page is closest to; null and 0 where nothing points to one or where it is not known."""
    marked, grid = _evidence(html, cards)
    key = F.when(marked >= grid, MARKED).otherwise(GRID)
    sure = (F.greatest(marked, grid) > 0) & key.isin(*known)
    return F.struct(F.when(sure, key).alias("template"), F.when(sure, F.greatest(marked, grid)).otherwise(0.0).alias("score"))


def source_kind(domain: Column, text: Column, kinds=keywords.SOURCE_KINDS) -> Column:
    """Kind of a source: channels by their host, then the first kind whose words or host sign occur."""
    low, by_host = F.lower(text), {"auction": F.contains(domain, F.lit("bankrot")), "government": domain.endswith(".gov.ru")}
    out = F.when(F.contains(domain, F.lit("t.me")), "telegram")
    for name, words in kinds:
        out = out.when(X.any_keyword(low, words) | by_host.get(name, F.lit(False)), name)
    return out.otherwise("unknown")


def channel(domain: Column, kind: Column, hosts=keywords.SOURCE_HOSTS) -> Column:
    """Channel under which a source is onboarded."""
    out = F.when(F.lit(False), "")
    for sign, name in hosts:
        out = out.when(F.contains(domain, F.lit(sign)), name)
    return out.when(kind == "auction", "bankrupt").otherwise("web")


def is_listing_link(channel_: Column, link: Column, paths=keywords.LISTING_PATHS, auction_words: Iterable[str] = keywords.AUCTION_LINKS, text: Column | None = None) -> Column:
    """Whether a link leads to a listing, by the rules of its channel; auctions go by words in link or anchor text."""
    host, path, low = N.domain(link), F.lower(F.regexp_extract(link, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)), F.lower(F.concat_ws(" ", link, text if text is not None else F.lit("")))
    out = F.when(channel_ == "bankrupt", X.any_keyword(low, auction_words))
    for name, (sign, pattern) in paths.items():
        out = out.when(channel_ == name, F.contains(host, F.lit(sign)) & path.rlike(pattern))
    return out.otherwise(False)


def priority(score: Column) -> Column:
    return F.when(score >= 80, "urgent").when(score >= 65, "high").when(score >= 50, "medium").otherwise("low")


def domains(scored: DataFrame) -> DataFrame:
    """One row for each domain: the best of every score, the kind of its latest page, first and last page, and its priority."""
    best = scored.groupBy("domain").agg(*(F.max(c).alias(c) for c in ("relevance", "density", "richness", "updates", "template")), F.max_by("kind", "page_id").alias("kind"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count(F.lit(1)).alias("pages"))
    return best.withColumn("priority", priority(F.col("relevance")))


def link_table(pages: DataFrame, hints: Iterable[str] = keywords.LISTING_HINTS, cap: int = LINK_CAP) -> DataFrame:
    """page_id, link, link_domain, anchor, internal and kind of each page's first links, without search engines."""
    rows = pages.select("page_id", "url", F.explode(F.slice(X.anchors(F.col("html")), 1, cap)).alias("a"))
    rows = rows.select("page_id", "url", N.unwrap_redirect(X.resolve_link(F.col("url"), F.col("a.href"))).alias("link"), F.left("a.text", F.lit(255)).alias("anchor")).withColumn("link_domain", N.domain(F.col("link")))
    rows = rows.where((F.col("link_domain") != "") & ~F.col("link_domain").isin(*keywords.SEARCH_HOSTS))
    return rows.select("page_id", "link", "link_domain", "anchor", (F.col("link_domain") == N.domain(F.col("url"))).alias("internal"), F.when(X.hint_count(F.col("link"), hints) > 0, "listing").otherwise("outbound").alias("kind"))


def frontier(links: DataFrame, scored: DataFrame, include_internal: bool = False) -> DataFrame:
    """Best priority of each link: 0.6 of its page's relevance, whole numbers."""
    rows = links if include_internal else links.where("NOT internal")
    return rows.join(scored.select("page_id", "relevance"), "page_id").groupBy("link").agg(F.max(F.floor(F.col("relevance") * 0.6).cast("int")).alias("priority"), F.count(F.lit(1)).alias("seen"))


def activation(relevance: Column, template: Column, density: Column, richness: Column, known_template: Column | None = None) -> Column:
    """What becomes of a source: reject, activate or review. known_template: whether a parser template is already assigned."""
    sure = (template >= 0.7) | (F.lit(False) if known_template is None else known_template)
    return (
        F.when((relevance < 40) | (density < 10), "reject").when((relevance >= 70) & (density >= 25) & sure, "activate")
        .when((relevance >= 55) & (density >= 20) & (richness >= 20) & (template >= 0.6), "activate").otherwise("review")
    )


def health(code: Column) -> Column:
    return F.when(code.isin(401, 403, 429), "blocked").when((code >= 200) & (code < 400), "healthy").otherwise("failed")


def streaks(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Each event with run, the successes or failures in a row up to it, and the state of the source after it.

    Three failures in a row pause a source and two successes in a row resume it; in between it keeps its state, and it
    starts active. So the state is that of the latest event that paused or resumed.
    """
    at = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("failed", failed)
    turn = F.when(F.lag("failed").over(at) == F.col("failed"), 0).otherwise(1)
    rows = rows.withColumn("turn", turn).withColumn("island", F.sum("turn").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.row_number().over(Window.partitionBy(key, "island").orderBy(*order)))
    change = F.when(F.col("failed") & (F.col("run") >= 3), "paused").when(~F.col("failed") & (F.col("run") >= 2), "active")
    state = F.last(change, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("state", F.coalesce(state, F.lit("active"))).drop("turn", "island")


def next_due_minutes(base: Column, failures: Column) -> Column:
    return F.greatest(F.lit(15), base * F.pow(F.lit(2), F.least(failures, F.lit(4)))).cast("int")


# Where seeds come from, in the order in which equal priorities are taken, with the priority that an origin gives.
ORIGINS = {"manual": None, "active_source": 80, "active_source_domain": 65, "keyword_pack": 60, "parser_results": 55, "frontier": None}
RECENT_DAYS, RECENT_ROWS, CLAIMED, SEED_REGION = 30, 400, 50, "RU-UDM"


def enqueue(frontier_: DataFrame, found: DataFrame, first_id: int = 0) -> DataFrame:
    """The frontier after a run found links: url, domain, priority, status, id, last_checked_at. A known url keeps its row and the higher priority.

    found: url, domain, priority. New urls get ids that differ from all stored ones and grow with first_id, the number of ids given before.
    """
    best = found.groupBy("url").agg(F.max("priority").alias("found"), F.min("domain").alias("found_domain"))
    rows = frontier_.join(best, "url", "full")
    fresh = F.lit(first_id) + F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    return rows.select(
        "url", F.coalesce("domain", "found_domain").alias("domain"), F.greatest("priority", "found").alias("priority"), F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("id", fresh).alias("id"), "last_checked_at"
    )


def claim(frontier_: DataFrame, at: Column, n: int = CLAIMED) -> tuple[DataFrame, DataFrame]:
    """(the n new links of the highest priority, the frontier with these in processing). Of equal priorities the later id comes first.

    The links claimed are n rows, written before the state changes, so that both results speak of the same ones.
    """
    best = frontier_.where("status = 'new'").orderBy(F.desc("priority"), F.desc("id")).limit(n)
    best = cut(best.select("id", "url", "domain", "priority"), "claimed")
    rows = frontier_.join(F.broadcast(best.select("id", F.lit(True).alias("taken"))), "id", "left")
    taken = F.coalesce("taken", F.lit(False))
    after = rows.select("url", "domain", "priority", F.when(taken, "processing").otherwise(F.col("status")).alias("status"), "id", F.when(taken, at).otherwise(F.col("last_checked_at")).alias("last_checked_at"))
    return best, after


def settle(frontier_: DataFrame, done: DataFrame) -> DataFrame:
    """The frontier after pages were read. done: id, failed; a page that could not be read ends in error, others are processed."""
    of = done.groupBy("id").agg(F.max("failed").alias("failed"))
    rows = frontier_.join(of, "id", "left")
    return rows.select("url", "domain", "priority", F.when(F.col("failed"), "error").when(~F.col("failed"), "processed").otherwise(F.col("status")).alias("status"), "id", "last_checked_at")


def seeds(manual: DataFrame, sources: DataFrame, results: DataFrame, claimed: DataFrame, as_of: Column, cap: int = 50, words: Iterable[str] = keywords.SEARCH_PACK, auto: bool = True) -> DataFrame:
    """seed_type, value, priority, region, seed_origin, frontier_id, rank of a run: the cap seeds of the highest priority, of all six origins.

    manual: id, seed_type, value, priority, region, enabled; sources: id, source_url, region_code, is_active; results: id, raw_url,
    created_at; claimed: of claim(). Equal priorities go by origin, then by id; a domain named by several results is a seed each time. Each
    origin hands on no more than cap rows, so only a few hundred are ordered together.
    """
    c, none = F.col, lambda kind: F.lit(None).cast(kind)
    def part(rows: DataFrame, origin: str, kind: Column, value: Column, given: Column, region: Column, order: Column, frontier_id: Column | None = None) -> DataFrame:
        turn = F.lit(list(ORIGINS).index(origin))
        out = rows.select(kind.alias("seed_type"), value.alias("value"), given.cast("int").alias("priority"), region.alias("region"), F.lit(origin).alias("seed_origin"), (none("long") if frontier_id is None else frontier_id.cast("long")).alias("frontier_id"), turn.alias("turn"), order.cast("long").alias("at"))
        return out.where("value IS NOT NULL AND value <> ''").orderBy(F.desc("priority"), "at").limit(cap)
    out = part(manual.where("enabled"), "manual", c("seed_type"), c("value"), F.coalesce("priority", F.lit(0)), c("region"), c("id"))
    if auto:
        active, given = sources.where("is_active"), lambda origin: F.lit(ORIGINS[origin])
        since = as_of - F.make_dt_interval(F.lit(RECENT_DAYS))
        recent = results.where((c("created_at") >= since) & c("raw_url").isNotNull()).orderBy("id").limit(RECENT_ROWS)
        pack = manual.sparkSession.createDataFrame(list(enumerate(words)), "id int, word string")
        for more in (
            part(active, "active_source", F.lit("url"), c("source_url"), given("active_source"), c("region_code"), c("id")),
            part(active, "active_source_domain", F.lit("domain"), N.domain(c("source_url")), given("active_source_domain"), c("region_code"), c("id")),
            part(pack, "keyword_pack", F.lit("keyword"), c("word"), given("keyword_pack"), F.lit(SEED_REGION), c("id")),
            part(recent, "parser_results", F.lit("domain"), N.domain(c("raw_url")), given("parser_results"), F.lit(SEED_REGION), c("id")),
            part(claimed, "frontier", F.lit("url"), c("url"), c("priority"), F.lit(SEED_REGION), -c("id"), c("id")),
        ):
            out = out.unionByName(more)
    first = Window.orderBy(F.desc("priority"), "turn", "at")  # at most cap rows of each origin
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= cap).drop("turn", "at")


def due(sources: DataFrame, as_of: Column, high_priority: bool = False) -> DataFrame:
    """Active sources whose next run is unset or not after as_of; in high-priority mode only those of priority 80 and more."""
    rows = sources.where(F.col("is_active") & (F.col("next_at").isNull() | (F.col("next_at") <= as_of)))
    return rows.where(F.coalesce("priority", F.lit(0)) >= 80) if high_priority else rows


def recent_messages(messages: DataFrame, at: str, permalink: str, channel: str, as_of: Column, days_back: int, allowed: DataFrame | None = None) -> DataFrame:
    """One row for each permalink of the last days_back days, the earliest; allowed: one column with the channels that count."""
    rows = messages.where((F.col(at) >= as_of - F.make_dt_interval(F.lit(days_back))) & (F.col(at) <= as_of))
    if allowed is not None:
        rows = rows.join(allowed.toDF("__allowed"), F.col(channel) == F.col("__allowed"), "left_semi")
    every = rows.groupBy(permalink).agg(F.min_by(F.struct(*(c for c in messages.columns if c != permalink)), F.struct(*(c for c in messages.columns if c != permalink))).alias("m"))
    return every.select(permalink, "m.*")


def merge_catalogue(stored: DataFrame, found: DataFrame, now: Column, allowed: DataFrame | None = None, relevant: Column | None = None, queries: int = 25, cap: int = 500) -> DataFrame:
    """The channel catalogue after a search: username, title, first_seen, last_seen, matched_queries.

    stored has these columns, found has (username, title, query). Stored channels stay if relevant holds for them or allowed
    names them; the title found last counts; queries are united, sorted and capped, and so are channels by name.
    """
    handle = N.channel_handle(F.col("username"))
    title = F.coalesce(F.nullif(N.squeeze(F.col("title")), F.lit("")), F.concat(F.lit("@"), handle))
    old = stored.withColumn("title", title).withColumn("username", handle).where("username <> ''")
    if relevant is not None:
        named = allowed.select(N.channel_handle(F.col(allowed.columns[0])).alias("username"), F.lit(True).alias("named")) if allowed is not None else None
        old = (old.join(named.distinct(), "username", "left") if named is not None else old.withColumn("named", F.lit(False))).where(relevant | F.coalesce("named", F.lit(False)))
    old = old.select("username", "title", "first_seen", "last_seen", F.explode_outer("matched_queries").alias("query"), F.lit(0).alias("turn"))
    new = found.select(handle.alias("username"), title.alias("title"), now.alias("first_seen"), now.alias("last_seen"), "query", F.lit(1).alias("turn")).where("username <> ''")
    rows = old.unionByName(new).withColumn("query", F.nullif(N.squeeze(F.col("query")), F.lit("")))
    merged = rows.groupBy("username").agg(F.max_by("title", F.struct("turn", "title")).alias("title"), F.min_by("first_seen", "turn").alias("first_seen"), F.max_by("last_seen", "turn").alias("last_seen"), F.slice(F.array_sort(F.collect_set("query")), 1, queries).alias("matched_queries"))
    return merged.orderBy("username").limit(cap)
