"""Link edges and the bounded breadth-first walk from many seeds at once.

The HTML is read once: contacts and normalised links are extracted in one narrow
pass, and the walk runs on the small edge table that comes out of it.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.functions import urls
from contactlake.functions.text import unfold
from contactlake.operators.run_tables import RunTables
from contactlake.operators.site_hosts import hosts_of_seeds, narrowest_domains
from contactlake.settings import Settings


def page_key(url):
    """The form of a page's URL that links are compared with: fragment, query and
    trailing slash dropped. Text that is no URL stays as it is."""
    return F.coalesce(urls.normalize_url(url, url), url)


def link_targets(contacts: DataFrame, url: str = "url") -> DataFrame:
    """Normalised link targets, resolved against the page's URL; distinct per page row.

    Repeats are dropped in the page's own array, so there is no shuffle.
    """
    found = contacts.select(
        F.col(url).alias("src_url"),
        urls.url_parts(F.coalesce(F.col(url), F.lit(""))).alias("base"),
        "links",
    )
    targets = F.transform("links", lambda link: urls.normalize_from(link, F.col("base")))
    return unfold(found, ["src_url"], F.array_distinct(F.array_compact(targets)), "dst_url")


#: Edges of a domain, and seeds of it, that meet in one task.
BLOCK_EDGES = 4096
#: Seeds that an edge's rows run through before the next edge comes.
SLICE = 256
#: Blocks of a domain's edges and of its seeds, and slices of each block.
COUNTS = ["edge_blocks", "seed_blocks", "edge_slices", "seed_slices"]


def slices_of_blocks(rows: DataFrame, value: Column, kind: str) -> DataFrame:
    """``domain, block, part, slice`` of distinct values and the other columns of ``rows``, which are the same for a domain.

    A hash deals a domain's values to as many blocks as column ``{kind}_blocks`` says. Each block is sorted and cut into as many
    slices as ``{kind}_slices`` says, all but the last of the same length, a multiple of eight. Some may be empty.
    """
    n_slices = F.col(f"{kind}_slices")
    block = F.pmod(F.xxhash64(value), F.col(f"{kind}_blocks")).alias("block")
    blocks = rows.groupBy("domain", *COUNTS, block).agg(F.sort_array(F.collect_list(value)).alias("values"))
    length = (F.ceil(F.size("values") / n_slices / 8) * 8).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_slices - 1), lambda i: F.struct(i.alias("part"), F.slice("values", i * length + 1, length).alias("slice")))
    return unfold(blocks, ["domain", *COUNTS, "block"], cut, "cut").select("domain", *COUNTS, "block", "cut.part", "cut.slice")


def same_domain_edges(edges: DataFrame, seeds: DataFrame, run: RunTables | None = None) -> DataFrame:
    """Edges of each seed's domain: ``(seed_url, src_url, dst_url)``.

    A page belongs to a seed when its host is the seed's domain or a subdomain of it. The few
    distinct hosts find their domains by order; the edges then join that small map by host, in one
    struct so that a hot host can be split. Whether an edge stays on the domain is settled there, once for all
    seeds of the domain.

    The result has a row for each edge and each seed of its domain, so it grows with their product. Edges and seeds
    of a domain are cut into blocks by a hash. Each pair of blocks is made in one task, a domain's pairs are dealt to the
    tasks in turn, and the more rows the result has the more tasks there are. So little moves beside the rows made: an
    edge once for each block of seeds, a seed once for each block of edges.

    Rows come in runs, through the edges of a block for each slice of its seeds: values repeat within few rows, and a task
    has few of them, so that files of the result store them in a fraction of a byte.
    """
    run = run or RunTables(edges.sparkSession)
    domains = seeds.select("seed_url", urls.get_domain(F.col("seed_url")).alias("domain")).filter("domain is not null").distinct()
    domains = run.save(domains, "seed_domains")
    # Edges are made distinct before they meet the domains, which multiply them.
    rows = edges.select("src_url", "dst_url").distinct().withColumn("host", urls.netloc_of(F.col("src_url")))
    rows = run.save(rows.withColumn("dst_host", urls.netloc_of(F.col("dst_url"))), "links")
    sites = domains.select(F.col("domain").alias("seed_url"), "domain").distinct()
    known = hosts_of_seeds(rows.select("host"), sites, run).select(F.struct("host").alias("host_key"), "domain")
    joined = rows.select("src_url", "dst_url", "dst_host", F.struct("host").alias("host_key")).join(known, "host_key")
    on_site = joined.filter(urls.netloc_in_domain(F.col("dst_host"), F.col("domain"))).select("domain", "src_url", "dst_url")
    on_site = run.save(on_site, "site_links")

    counts = on_site.groupBy("domain").agg(F.count("*").alias("edges")).join(domains.groupBy("domain").agg(F.count("*").alias("seeds")), "domain")
    for kind in ("edge", "seed"):
        counts = counts.withColumn(f"{kind}_blocks", F.ceil(F.col(f"{kind}s") / BLOCK_EDGES))
        counts = counts.withColumn(f"{kind}_slices", F.ceil(F.col(f"{kind}s") / F.col(f"{kind}_blocks") / SLICE).cast("int"))
    counts = run.save(counts, "domain_counts")
    full_pairs = counts.agg(F.sum((F.col("edges") / BLOCK_EDGES) * (F.col("seeds") / BLOCK_EDGES))).first()[0] or 0
    n_tasks = max(run.n_buckets, math.ceil(full_pairs))
    sizes = counts.select("domain", *COUNTS)

    def of_pairs(slices: DataFrame, others: str, edge_block: str, seed_block: str) -> DataFrame:
        """Slices once for each block that theirs meets, in the task of this pair of blocks."""
        met = slices.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1)))
        met = met.withColumn("pair", F.col(edge_block) * F.col("seed_blocks") + F.col(seed_block))
        task = F.pmod(F.hash("domain").cast("bigint") + F.col("pair"), F.lit(n_tasks)).cast("int")
        return met.select(task.alias("task"), "domain", "pair", "seed_slices", "part", "slice").repartitionById(n_tasks, "task")

    edge_slices = of_pairs(slices_of_blocks(on_site.join(sizes, "domain"), F.struct("src_url", "dst_url"), "edge"), "seed_blocks", "block", "other")
    seed_slices = of_pairs(slices_of_blocks(domains.join(sizes, "domain"), F.col("seed_url"), "seed"), "edge_blocks", "other", "block")
    key = ["task", "domain", "pair", "part"]
    links = edge_slices.select("task", "domain", "pair", "seed_slices", F.inline("slice"))
    links = links.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("seed_slices") - 1))).drop("seed_slices")
    # A merge join keeps this order and holds the rows of one edge and one slice at a time; a hash join may hold those of a whole block.
    rows = links.hint("merge").join(seed_slices.select(*key, "slice"), key)
    return rows.select(F.explode("slice").alias("seed_url"), "src_url", "dst_url")


def edges_on_sites(edges: DataFrame, seeds: DataFrame, run: RunTables | None = None) -> DataFrame:
    """Edges ``(src_url, dst_url, host)`` that lead to the domain of some seed.

    Links that leave every site are most of a real page's links and can never be
    followed. Each distinct host is looked up once. The edges go to a table of the run first, as
    their hosts and they themselves are both needed and may come straight from parsing.
    """
    run = run or RunTables(edges.sparkSession)
    domains = seeds.select(urls.get_domain(F.col("seed_url")).alias("domain")).filter("domain is not null").distinct()
    targets = run.save(edges.select("src_url", "dst_url", urls.netloc_of(F.col("dst_url")).alias("host")), "targets")
    known = narrowest_domains(targets.select("host"), domains, run).select(F.struct("host").alias("host_key"))
    # The key is wrapped so that both sides are exchanged and a host with many links can be split.
    return targets.withColumn("host_key", F.struct("host")).join(known, "host_key", "left_semi").drop("host_key")


def seed_states(seeds: DataFrame) -> DataFrame:
    """Distinct walkable seeds: the text as given and its page key."""
    return (
        seeds.select("seed_url")
        .distinct()
        .filter(urls.validate_url(F.col("seed_url")))
        .select("seed_url", page_key(F.col("seed_url")).alias("url"))
    )


def within_budget(found: DataFrame, max_pages: int) -> DataFrame:
    """The first URLs (in order) of each seed's new level that its budget still allows.

    Rows carry ``used``, the pages the seed has visited so far, and come out with
    the count that includes them. The rank is limited by a constant first, which
    Spark applies before it gathers a seed's rows.
    """
    seed = Window.partitionBy("seed_url")
    ranked = found.withColumn("_rank", F.row_number().over(seed.orderBy("url")))
    ranked = ranked.filter(F.col("_rank") <= max_pages)
    allowed = ranked.filter(F.col("_rank") <= max_pages - F.col("used"))
    return allowed.withColumn("used", F.col("used") + F.count("*").over(seed)).drop("_rank")


def steps_from(level: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that a level follows, with the level's other columns: ``seed_url, dst_url, ...``.

    The edges of the level's distinct pages are picked where they lie. Only these few are
    joined with the level, where adaptive execution can split a page that many seeds reach.
    """
    wanted = level.select(F.col("url").alias("src_url")).distinct()
    followed = edges.join(wanted, "src_url", "left_semi")
    sources = level.withColumnRenamed("url", "src_url").withColumn("domain", urls.netloc_of(F.col("seed_url")))
    return sources.join(followed, "src_url").filter(urls.netloc_in_domain(F.col("host"), F.col("domain")))


def new_in_level(level: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """``seed_url, url, used`` of the pages that a level leads to and no seed has visited.

    ``visited`` in buckets of seed and URL is read where it lies; only the found pages move.
    """
    found = steps_from(level, edges).groupBy("seed_url", F.col("dst_url").alias("url")).agg(F.max("used").alias("used"))
    return found.join(visited.select("seed_url", "url"), ["seed_url", "url"], "left_anti")


def closer_pages(step: DataFrame, hops: DataFrame, best: DataFrame) -> DataFrame:
    """``seed_url, url, depth`` of the pages that a step reaches at a smaller depth than known so far."""
    found = steps_from(step, hops).groupBy("seed_url", F.col("dst_url").alias("url")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
    known = best.groupBy("seed_url", "url").agg(F.min("depth").alias("known"))
    closer = found.join(known, ["seed_url", "url"], "left").filter("known is null or depth < known")
    return closer.drop("known")


class Chains(NamedTuple):
    hops: DataFrame  # src_url, dst_url, host, length: edges, and whole chains as one
    members: DataFrame | None  # head_url, url, offset: pages of a chain and their distance from its head
    rounds: int


def contract_chains(edges: DataFrame, starts: DataFrame, run: RunTables) -> Chains:
    """Runs of pages with one link in and one link out become one hop.

    A page belongs to a chain when its only link comes from a page of its own host, it has one
    link itself, and no seed starts there: whoever visits the page before it visits it, too. Each page learns
    the distance to the first page of its chain by doubling, in as many rounds as the length has
    binary digits. Circles that nothing leads into have no first page and are left out.
    """
    own = edges.groupBy("src_url").agg(F.count("*").alias("n_out"), F.min("dst_url").alias("next_url"), F.min("host").alias("next_host"))
    into = edges.groupBy("dst_url").agg(F.count("*").alias("n_in"), F.min("src_url").alias("up_url"), F.min("host").alias("host"))
    inner = into.filter((F.col("n_in") == 1) & (F.col("host") == urls.netloc_of(F.col("up_url")))).withColumnRenamed("dst_url", "url")
    inner = inner.join(own.filter("n_out = 1").withColumnRenamed("src_url", "url"), "url").join(starts, "url", "left_anti")
    inner = run.save(inner.select("url", "up_url", "next_url", "next_host"), "chain_pages")
    n_inner = inner.count()
    if not n_inner:
        return Chains(edges.withColumn("length", F.lit(1)), None, 0)
    inside = inner.select(F.col("url").alias("up_url"), F.lit(True).alias("inside"))
    jumps = inner.join(inside, "up_url", "left").select(
        "url",
        F.when(F.col("inside"), F.col("up_url")).otherwise(F.col("url")).alias("to_url"),
        F.when(F.col("inside"), 1).otherwise(0).cast("bigint").alias("offset"),
        F.col("inside").isNull().alias("done"),
    )
    jumps, rounds = run.save(jumps, "jumps_0"), 0
    while 2**rounds <= n_inner and not jumps.filter(~F.col("done")).isEmpty():
        ahead = jumps.select(F.col("url").alias("to_url"), F.col("to_url").alias("next_to"), F.col("offset").alias("more"), F.col("done").alias("ends"))
        moved = jumps.filter(~F.col("done")).join(ahead, "to_url")
        moved = moved.select("url", F.col("next_to").alias("to_url"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ends").alias("done"))
        rounds += 1
        jumps = run.save(jumps.filter("done").unionByName(moved), f"jumps_{rounds}")
    first = inner.select(F.col("url").alias("to_url"), F.col("up_url").alias("head_url"))
    members = jumps.filter("done").join(first, "to_url").select("head_url", "url", (F.col("offset") + 1).alias("offset"))
    members = run.save(members, "chains")
    inside = inner.select(F.col("url").alias("dst_url"))
    last = inner.join(inside.withColumnRenamed("dst_url", "next_url"), "next_url", "left_anti")
    whole = members.join(last, "url").select(
        F.col("head_url").alias("src_url"), F.col("next_url").alias("dst_url"), F.col("next_host").alias("host"), (F.col("offset") + 1).cast("int").alias("length")
    )
    plain = edges.join(inside, "dst_url", "left_anti").join(inside.withColumnRenamed("dst_url", "src_url"), "src_url", "left_anti")
    hops = plain.select("src_url", "dst_url", "host", F.lit(1).alias("length")).unionByName(whole)
    return Chains(run.save_bucketed(hops, "hops", "src_url"), members, rounds)


class Walk(NamedTuple):
    visited: DataFrame  # seed_url, url, depth
    rounds: int


def walk(seeds: DataFrame, edges: DataFrame, max_pages: int | None, run: RunTables) -> Walk:
    """The walk behind ``reachable_pages`` and how many rounds it took, those for chains included."""
    seeds = run.save(seeds.select("seed_url").distinct(), "seeds")
    edges = edges_on_sites(edges, seeds, run).filter("src_url <> dst_url")
    edges = run.save_bucketed(edges, "edges", "src_url")
    states = seed_states(seeds)
    key = ["seed_url", "url"]
    if max_pages is None:
        chains = contract_chains(edges, states.select("url").distinct(), run)
        first = states.select(*key, F.lit(0).cast("bigint").alias("depth"), F.lit(0).alias("step"))
        run.append(first.repartition(run.n_buckets, *key), "reached", "step", *key)
        for step in itertools.count(1):
            reached = run.table("reached")
            found = closer_pages(reached.filter(F.col("step") == step - 1).drop("step"), chains.hops, reached)
            if not run.append(found.withColumn("step", F.lit(step)), "reached", "step", *key):
                break
        visited = run.table("reached").groupBy(*key).agg(F.min("depth").alias("depth"))
        if chains.members is not None:
            heads = visited.withColumnRenamed("url", "head_url")
            inner = heads.join(chains.members, "head_url").select(*key, (F.col("depth") + F.col("offset")).alias("depth"))
            visited = run.save(visited.unionByName(inner), "visited")
        return Walk(visited, chains.rounds + step)
    first = states.select(*key, F.lit(1).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("depth"))
    run.append(first.repartition(run.n_buckets, *key), "visited", "depth", *key)
    for depth in itertools.count(1):
        visited = run.table("visited")
        level = visited.filter((F.col("depth") == depth - 1) & (F.col("used") < max_pages)).drop("depth")
        found = within_budget(new_in_level(level, edges, visited), max_pages).withColumn("depth", F.lit(depth).cast("bigint"))
        if not run.append(found.repartition(run.n_buckets, *key), "visited", "depth", *key):
            return Walk(run.table("visited").select(*key, "depth"), depth)


def reachable_pages(seeds: DataFrame, edges: DataFrame, max_pages: int | None = Settings().max_pages, run: RunTables | None = None) -> DataFrame:
    """``(seed_url, url, depth)`` of the pages visited from each seed, breadth first.

    All seeds advance together, one round per level, until no seed finds a new page. Each
    URL is visited once per seed; a URL without a page counts as visited. With a budget,
    URLs of a level are taken in order until ``max_pages`` are used up, and a seed that has
    used them is not followed any further. With None the whole site is visited; chains of
    pages are then one step of a round, so that a deep site takes few.

    Edges that lead to no seed's domain are dropped first; the others lie in buckets of their
    source, the visited pages in buckets of seed and URL. A round reads both where they lie, moves
    what it found and adds it to the visited table of ``run``. Only the number of
    new pages comes to the driver. The tables stay until ``run.drop()``.
    """
    return walk(seeds, edges, max_pages, run or RunTables(edges.sparkSession)).visited


def unvisited_links(targets: DataFrame, visited: DataFrame) -> DataFrame:
    """Link targets of a seed that are not visited yet."""
    return targets.join(visited.select("seed_url", "url"), ["seed_url", "url"], "left_anti")


def frontier_pages(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs with ``fetched``: whether the page table has them, however often."""
    have = pages.select("url").distinct().withColumn("fetched", F.lit(True))
    return frontier.join(have, "url", "left").withColumn(
        "fetched", F.coalesce("fetched", F.lit(False))
    )


def crawl_progress(visited: DataFrame, page_urls: DataFrame, max_pages: int) -> DataFrame:
    """Per seed: pages visited, pages that gave a result, and whether the budget is used up."""
    state = frontier_pages(visited, page_urls)
    return state.groupBy("seed_url").agg(
        F.count("*").alias("visited"),
        F.count_if("fetched").alias("results"),
        (F.count("*") >= max_pages).alias("limit_reached"),
        F.max("depth").cast("bigint").alias("depth"),
    )
