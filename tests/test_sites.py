"""Walks, batches, reports, sinks, sources and streams."""

import datetime
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contactlake import Settings
from contactlake.operators import dedup, graph, reports, site_hosts, sites
from contactlake.operators.run_tables import RunTables
from contactlake.sources import pages as page_source
from contactlake.sources import sinks
from contactlake.streaming.contacts import contacts_stream, new_contacts_stream

SIMPLE = Settings(max_pages=3, validate_emails=False, validate_phones=False)
PAGES = [
    (1, "https://example.com/", '<a href="https://example.com/page1">1</a><a href="/page2?x#y">2</a><a href="https://other.org/">o</a>'),
    (2, "https://example.com/page1", '<p>Email: page1@gmail.com</p> <a href="/">home</a><a href="/missing">m</a><a href="https://sub.example.com/s">s</a>'),
    (3, "https://example.com/page2", "<p>Phone: 8-916-123-45-67</p>"),
    (4, "https://example.com/page2", "<p>copy@gmail.com of page 2</p>"),
    (5, "https://sub.example.com/s", "<p>sub@gmail.com</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def seeds(spark, *urls):
    return spark.createDataFrame(list(enumerate(urls)), "seq long, seed_url string")


def test_walk_three_pages(spark, pages):
    row = sites.site_contacts(pages, seeds(spark, "https://example.com"), SIMPLE).first()
    assert row.emails == ["page1@gmail.com"] and row.phones == ["89161234567", "9161234567"]


def test_budget_depth_and_missing_pages(spark, pages):
    walk = sites.walk_sites(pages, seeds(spark, "https://example.com", "https://example.com"), Settings(max_pages=10))
    got = sorted(tuple(r) for r in walk.visited.collect())
    site = "https://example.com"
    assert got == sorted([
        (site, site, 0), (site, site + "/page1", 1), (site, site + "/page2", 1),
        (site, site + "/missing", 2), (site, "https://sub.example.com/s", 2),
    ])
    progress = graph.crawl_progress(walk.visited, walk.contacts, 10).first()
    assert (progress.visited, progress.results, progress.limit_reached, progress.depth) == (5, 4, False, 2)
    for budget in (1, 2, 4):
        visited = sites.walk_sites(pages, seeds(spark, site), Settings(max_pages=budget)).visited
        order = sorted(got, key=lambda r: (r[2], r[1]))[:budget]
        assert sorted(tuple(r) for r in visited.collect()) == sorted(order)


def test_long_chain(spark):
    """More levels than are kept between two compactions, against plain Python."""
    rows = [(i, f"https://c.ru/{i}", f'<a href="/{i + 1}">n</a><a href="/{i // 2}">b</a>') for i in range(14)]
    chain = spark.createDataFrame(rows, "page_id long, url string, html string")
    visited = sites.walk_sites(chain, seeds(spark, "https://c.ru/0"), Settings(max_pages=12)).visited
    assert sorted(r.depth for r in visited.collect()) == list(range(12))


def test_whole_site_of_a_deep_chain(spark):
    rows = [(i, f"https://c.ru/{i}", f'<a href="/{i + 1}">n</a><a href="https://elsewhere.org/{i}">x</a>') for i in range(60)]
    chain = spark.createDataFrame(rows, "page_id long, url string, html string")
    visited = sites.walk_sites(chain, seeds(spark, "https://c.ru/0"), Settings(max_pages=None)).visited
    assert sorted(r.depth for r in visited.collect()) == list(range(61))


def edge_table(spark, pairs):
    return spark.createDataFrame([(f"https://c.ru/{a}", f"https://c.ru/{b}") for a, b in pairs], "src_url string, dst_url string")


def plain_depths(pairs, start):
    nearest, level, out = {start: 0}, [start], {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    while level:
        level = sorted({b for a in level for b in out.get(a, []) if b not in nearest} - set(nearest))
        nearest.update({b: nearest[next(a for a in nearest if b in out.get(a, []))] + 1 for b in level})
    return nearest


def test_five_thousand_pages_in_a_row_take_few_rounds(spark):
    pairs = [(i, i + 1) for i in range(5000)] + [(i, i) for i in range(0, 5000, 7)]
    with RunTables(spark) as run:
        walk = graph.walk(seeds(spark, "https://c.ru/0", "https://c.ru/2500"), edge_table(spark, pairs), None, run)
        depths = {(r.seed_url, r.url): r.depth for r in walk.visited.collect()}
    assert walk.rounds < 20
    want = {("https://c.ru/0", f"https://c.ru/{i}"): i for i in range(5001)}
    want |= {("https://c.ru/2500", f"https://c.ru/{i}"): i - 2500 for i in range(2500, 5001)}
    assert depths == want


@pytest.mark.parametrize("case", range(6))
def test_chains_in_graphs_against_a_plain_walk(spark, case):
    r = random.Random(case)
    pairs, n = [], 0
    knots = list(range(12))
    for _ in range(25):  # knots joined by chains of all lengths, loops and chains that end included
        a, b, length = r.choice(knots), r.choice(knots), r.choice([0, 0, 1, 2, 5, 9])
        inner = [f"x{n + i}" for i in range(length)]
        n += length
        row = [f"k{a}", *inner] + ([f"k{b}"] if r.random() < 0.8 else [])
        pairs += list(zip(row, row[1:]))
    pairs += [("o0", "o1"), ("o1", "o2"), ("o2", "o0"), ("p0", "p0")]  # circles that nothing leads into
    starts = ["k0", "k5", "x3", "o1"]
    with RunTables(spark) as run:
        walk = graph.walk(seeds(spark, *[f"https://c.ru/{s}" for s in starts]), edge_table(spark, pairs + pairs[:5]), None, run)
        got = {(r.seed_url, r.url, r.depth) for r in walk.visited.collect()}
    want = {(f"https://c.ru/{s}", f"https://c.ru/{u}", d) for s in starts for u, d in plain_depths(pairs, s).items()}
    assert got == want


def test_chains_across_hosts_keep_to_the_sites(spark):
    rows = [("https://a.ru/1", "https://x.a.ru/1"), ("https://x.a.ru/1", "https://x.a.ru/2"), ("https://x.a.ru/2", "https://a.ru/2"), ("https://a.ru/2", "https://a.ru/3")]
    edges = spark.createDataFrame(rows, "src_url string, dst_url string")
    with RunTables(spark) as run:
        walk = graph.walk(seeds(spark, "https://a.ru/1", "https://x.a.ru/1"), edges, None, run)
        got = {(r.seed_url, r.url, r.depth) for r in walk.visited.collect()}
    a, x = "https://a.ru/1", "https://x.a.ru/1"
    assert got == {(a, a, 0), (a, x, 1), (a, "https://x.a.ru/2", 2), (a, "https://a.ru/2", 3), (a, "https://a.ru/3", 4), (x, x, 0), (x, "https://x.a.ru/2", 1)}


def test_a_site_with_a_million_contacts(spark):
    with RunTables(spark) as run:
        number = F.lpad(F.col("id").cast("string"), 7, "0")
        rows = spark.range(1_000_000).select(F.lit("https://hot.ru").alias("seed_url"), F.lit("email").alias("kind"), F.concat(F.lit("u"), number, F.lit("@hot.ru")).alias("value"))
        small = spark.createDataFrame([("https://b.ru", "phone", "+79991234567"), ("https://b.ru", "phone", "+79991234567 "), ("https://b.ru", "email", "A@b.ru"), ("https://b.ru", "email", "bad")], rows.schema)
        parts = run.save(reports.contact_parts(rows.union(rows.limit(1000)).union(small), run, 1000), "parts")
        hot = parts.filter("seed_url = 'https://hot.ru'")
        assert hot.agg(F.count("*"), F.sum(F.size("values")), F.max(F.size("values")), F.max("part")).first() == (1000, 1_000_000, 1000, 999)
        assert hot.filter("part = 17").first()["values"] == [f"u{i:07d}@hot.ru" for i in range(17_000, 18_000)]
        assert sorted((r.kind, r.part, r["values"]) for r in parts.filter("seed_url = 'https://b.ru'").collect()) == [
            ("email", 0, ["a@b.ru"]), ("phone", 0, ["+79991234567"])
        ]


def test_whole_sites_come_in_parts_only(spark, pages):
    with pytest.raises(ValueError, match="site_contact_parts"):
        sites.site_contacts(pages, seeds(spark, "https://example.com"), Settings(max_pages=None))


def test_status_of_sites(spark):
    rows = [(1, "https://a.ru/", '<p>x@mail.ru </p><a href="/b">b</a>'), (2, "https://b.ru/", "<p>nothing</p>"), (3, "https://a.ru/b", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    lines = seeds(spark, "https://a.ru", "https://b.ru", "https://c.ru", "no url", "https://a.ru")
    whole = Settings(max_pages=None)
    with RunTables(spark) as run:
        rows = sites.batch_status(sites.walk_sites(table, lines, whole, run), lines, whole).orderBy("seq").collect()
    assert [(r.success, r.status, r.visited, r.results) for r in rows] == [
        (True, "ok", 2, 2), (True, "no_contacts", 1, 1), (False, "no_page", 1, 0), (False, "not_a_url", 0, 0), (True, "ok", 2, 2)
    ]


def test_tables_of_a_run_go_with_it(spark, pages):
    with RunTables(spark) as run:
        assert sites.site_contacts(pages, seeds(spark, "https://example.com"), SIMPLE, run).count() == 1
        folder = Path(run.folder.removeprefix("file:"))
        assert any(folder.iterdir())
    assert not folder.exists() and run.name not in [d.name for d in spark.catalog.listDatabases()]


def test_edges_of_a_hot_domain_are_spread_over_tasks(spark):
    """One domain has all but a few edges; they meet its seeds in blocks, in many tasks."""
    rows = [(f"https://hot.ru/{i}", f"https://{'x.' * (i % 2)}hot.ru/{i + 1}") for i in range(3 * graph.BLOCK_EDGES)]
    rows += [("https://x.hot.ru/1", "https://x.hot.ru/2"), ("https://hot.ru/1", "https://cold.ru/1"), ("https://cold.ru/1", "https://cold.ru/2"), (None, "https://hot.ru/9")]
    names = [f"https://hot.ru/?s={i}" for i in range(20)] + ["https://x.hot.ru", "https://cold.ru/1", "https://cold.ru/1", "none"]
    edges = spark.createDataFrame(rows + rows[:50], "src_url string, dst_url string")
    with RunTables(spark) as run:
        found = graph.same_domain_edges(edges, seeds(spark, *names), run).withColumn("task", F.spark_partition_id())
        got = [tuple(r) for r in found.collect()]
    host = lambda url: (url or "").split("/")[2] if url else ""
    within = lambda h, d: h == d or h.endswith("." + d)
    want = [(s, a, b) for s in set(names) - {"none"} for a, b in rows if within(host(a), host(s)) and within(host(b), host(s))]
    assert sorted(r[:3] for r in got) == sorted(want)
    assert len({r[3] for r in got if "hot.ru" in r[0]}) > 1


@pytest.mark.parametrize("block, part, n_buckets", [(16, 8, 4), (50, 7, 3), (1000, 256, 1)])
def test_blocks_of_edges_meet_blocks_of_seeds(spark, monkeypatch, block, part, n_buckets):
    """Against the rule itself, however blocks and their slices fall; domains with one seed, one edge or none included."""
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    monkeypatch.setattr(graph, "SLICE", part)
    rows = [(f"https://{d}hot.ru/{i}", f"https://hot.ru/{i % 40}/{j}") for i in range(97) for j, d in enumerate(["", "x."])]
    rows += [("https://one.ru/1", "https://one.ru/2"), ("https://out.ru/1", "https://hot.ru/1"), (None, "https://hot.ru/9"), ("https://hot.ru/1", None), *rows[:9]]
    names = [f"https://hot.ru/?s={i}" for i in range(131)] + [f"https://one.ru/{i}" for i in range(60)] + ["https://x.hot.ru", "https://out.ru", "https://none.ru", "none"]
    with RunTables(spark) as run:
        run.n_buckets = n_buckets
        edges = spark.createDataFrame(rows, "src_url string, dst_url string")
        got = [tuple(r) for r in graph.same_domain_edges(edges, seeds(spark, *names, names[0]), run).collect()]
    host = lambda url: url.split("/")[2] if url and "/" in url else ""
    within = lambda h, d: h == d or h.endswith("." + d)
    want = {(s, a, b) for s in names if host(s) for a, b in rows if within(host(a), host(s)) and within(host(b), host(s))}
    assert len(want) > 194 * 131 and sorted(got) == sorted(want)


def test_no_edges_or_no_seeds_of_a_domain(spark):
    edges = spark.createDataFrame([("https://a.ru/1", "https://a.ru/2")], "src_url string, dst_url string")
    with RunTables(spark) as run:
        assert graph.same_domain_edges(edges, seeds(spark, "https://b.ru", "none"), run).collect() == []
    with RunTables(spark) as run:
        assert graph.same_domain_edges(edges.limit(0), seeds(spark, "https://a.ru"), run).collect() == []


def test_edges_of_many_seeds_are_stored_small(spark, tmp_path):
    """Rows that share their values stand together, so that a file takes little more than a row's share of the distinct values."""
    rows = spark.range(5000).select(F.format_string("https://hot.ru/page/%d", "id").alias("src_url"), F.format_string("https://hot.ru/to/%d", F.col("id") * 7).alias("dst_url"))
    names = spark.range(1500).select(F.format_string("https://hot.ru/seed/%d", "id").alias("seed_url"))
    with RunTables(spark) as run:
        graph.same_domain_edges(rows, names, run).write.parquet(f"{tmp_path}/out")
        found = spark.read.parquet(f"{tmp_path}/out")
        assert found.count() == 5000 * 1500
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * 5000 * 1500


HOSTS = [
    "shop.ru", "www.shop.ru", "a.b.shop.ru", "notshop.ru", "shop.ru.evil.org", "shop.ru:8080", "x.shop.ru:8080", "b.shop.ru", "c.b.shop.ru", "ru", "", "shop-x.ru",
    "shop.com", "z.com", "a.z.com", "com", "user@shop.ru", "localhost", "SHOP.RU", "c.shop.ru", "zz.shop.ru", "shop.rua", "0.shop.ru",
]
DOMAINS = ["shop.ru", "b.shop.ru", "c.b.shop.ru", "shop.ru:8080", "z.com", "localhost", "none.net", "aa.shop.ru"]


@pytest.mark.parametrize("n", [1, 4, 50])
def test_hosts_find_their_sites(spark, n):
    """Against the rule itself, ports and nested domains included, however the order is cut."""
    hosts = spark.createDataFrame([(h,) for h in HOSTS * 3] + [(None,)], "host string")
    domains = spark.createDataFrame([(f"https://{d}/{i}", d) for d in DOMAINS for i in range(2)], "seed_url string, domain string")
    with RunTables(spark) as run:
        run.n_buckets = n
        got = [tuple(r) for r in site_hosts.hosts_of_seeds(hosts, domains, run).collect()]
        plan = site_hosts.narrowest_domains(hosts, domains.limit(0), run)
        assert plan.collect() == []
    want = {(h, f"https://{d}/{i}", d) for h in HOSTS for d in DOMAINS for i in range(2) if h == d or h.endswith("." + d)}
    assert sorted(got) == sorted(want)


def test_hosts_are_not_multiplied_by_their_labels(spark):
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    domains = spark.createDataFrame([(d,) for d in DOMAINS], "domain string")
    with RunTables(spark) as run:
        found = site_hosts.narrowest_domains(hosts, domains, run)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_without_ids(spark, pages):
    found = sites.site_contacts(pages.drop("page_id"), seeds(spark, "https://example.com"), Settings(max_pages=2))
    assert found.first().limit_reached is True


def test_many_seeds_on_one_page(spark, pages):
    """A page that all seeds reach, and each seed's walk stays its own."""
    many = [f"https://example.com/page1?s={i}" for i in range(40)]
    visited = sites.walk_sites(pages, seeds(spark, *many), Settings(max_pages=50)).visited
    counts = visited.groupBy("seed_url").count().collect()
    assert len(counts) == 40 and {r["count"] for r in counts} == {5}


def test_batch_keeps_lines_and_failures(spark, pages):
    lines = seeds(spark, "https://example.com", "not-a-url", "https://nowhere.ru", "https://example.com")
    rows = sites.batch_contacts(pages, lines, Settings(max_pages=5)).collect()
    assert [(r.seq, r.success) for r in rows] == [(0, True), (1, False), (2, False), (3, True)]
    assert rows[0].emails == rows[3].emails and rows[1].emails == [] == rows[2].phones


def test_seed_that_has_no_page_gives_no_result(spark, pages):
    walk = sites.walk_sites(pages, seeds(spark, "https://nowhere.ru"), SIMPLE)
    assert walk.visited.join(walk.contacts, "url").count() == 0


def test_dedup_pages(pages):
    assert sorted(r.page_id for r in dedup.dedup_pages(pages).collect()) == [1, 2, 3, 5]


def test_dedup_rows_that_repeat_or_lack_keys(spark):
    rows = [(5, "w"), (5, "w"), (1, "u"), (3, "u"), (3, "v"), (7, None), (8, None)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted(map(tuple, dedup.dedup_pages(table).collect()), key=repr) == [(1, "u"), (3, "v"), (5, "w"), (7, None), (8, None)]
    without_id = table.drop("page_id").withColumn("tags", F.array("url"))
    assert sorted(str(r.url) for r in dedup.dedup_pages(without_id).collect()) == ["None", "None", "u", "v", "w"]
    assert dedup.dedup_pages(table.limit(0)).count() == 0


def test_admission(spark):
    rows = [
        (1, "a", "<p>", 200, "text/HTML; charset=x", 5), (2, "b", "<p>", 404, "text/html", 5),
        (3, "c", "<p>", 200, "image/png", 5), (4, "d", "<p>", 200, "application/xhtml+xml", 10 * 2**20),
        (5, "e", "<p>", 200, "text/html", 10 * 2**20 + 1), (6, "f", "é" * (5 * 2**20 + 1), 200, "text/html", 5),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, content_type string, content_length long")
    assert sorted(r.page_id for r in page_source.admitted_pages(table).collect()) == [1, 4]
    assert sorted(r.page_id for r in page_source.admitted_pages(table.select("page_id", "url", "html")).collect()) == [1, 2, 3, 4, 5]


def test_seed_file(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text("  https://a.ru \n\n \nhttps://b.ru\nhttps://a.ru\n", encoding="utf-8")
    rows = page_source.read_seeds(spark, str(path)).orderBy("seq").collect()
    assert [r.seed_url for r in rows] == ["https://a.ru", "https://b.ru", "https://a.ru"]
    path.write_text("\n \n")
    with pytest.raises(ValueError):
        page_source.read_seeds(spark, str(path))


def test_page_table_needs_its_columns(spark, tmp_path):
    spark.range(1).write.json(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        page_source.read_pages(spark, str(tmp_path / "p"), "json")


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        (1, "https://example.com", True, ["test@example.com"], []), (2, "https://test.org", False, [], []),
        (3, None, None, None, None), (4, "нет", True, [], ["+79991234567"]),
    ]
    return spark.createDataFrame(rows, "seq long, url string, success boolean, emails array<string>, phones array<string>")


def test_summary(results):
    assert tuple(reports.batch_summary(results).first()) == (4, 2, 2)
    assert [tuple(r) for r in reports.batch_rows(results).collect()] == [
        ("https://example.com", True, 1, 0), ("https://test.org", False, 0, 0), ("", False, 0, 0), ("нет", True, 0, 1)
    ]


def test_json_sink(results, tmp_path):
    sinks.write_json(results.coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 4 and lines[0]["_metadata"]["parser_version"] == "2.0.0"
    assert "нет" in "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("*.json"))
    stamp = F.lit(datetime.datetime(2024, 1, 1))
    assert sinks.with_metadata(results, stamp).first()["_metadata"]["generated_at"] == datetime.datetime(2024, 1, 1)


def test_partitioned_sink(spark, results, tmp_path):
    sinks.write_partitions(results, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.seq, r.status, r.domain_slug) for r in back.collect()) == [
        (1, "ok", "example_com"), (2, "error", "none"), (3, "error", "none"), (4, "no_domain", "none")
    ]


def test_stream(spark, pages, tmp_path):
    timed = pages.withColumn("ts", F.timestamp_seconds(F.col("page_id") * 60))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    timed.write.parquet(source)
    timed.withColumn("page_id", F.col("page_id") + 100).write.mode("append").parquet(source)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def finish(frame, name):
        run = frame.writeStream.format("parquet").option("path", out + name).option("checkpointLocation", out + name + "-state")
        run.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out + name)

    assert finish(contacts_stream(stream), "all").count() == 8
    once = finish(new_contacts_stream(stream, "ts"), "once")
    assert sorted((r.site, r.value) for r in once.collect()) == [
        ("example.com", "+19161234567"), ("example.com", "copy@gmail.com"), ("example.com", "page1@gmail.com"), ("sub.example.com", "sub@gmail.com")
    ]


def test_lookup_joins(spark):
    from contactlake.operators import lookup_joins

    rows = spark.createDataFrame([("https://a.by", "375291234567"), ("https://a.zz", "999"), ("https://a.com", "15551234567")], "url string, digits string")
    joined = lookup_joins.with_country_lengths(lookup_joins.with_country_code(lookup_joins.with_home_code(rows), "digits"))
    got = {r.url: (r.home_code, r.code, r.lengths) for r in joined.collect()}
    assert got == {"https://a.by": ("375", "375", [9, 12]), "https://a.zz": (None, None, None), "https://a.com": ("1", "1", [10, 11])}
