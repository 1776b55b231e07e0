"""What the plans must keep to at scale."""

import pytest
from pyspark.sql import functions as F

from contactlake.operators import extract, graph, reports
from contactlake.operators.run_tables import RunTables
from contactlake.plans import queries

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scan(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_page_contacts_never_shuffles(spark):
    text = plan(extract.page_contacts(scan(spark)))
    assert "Exchange" not in text and "BatchEvalPython" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("make", [
    lambda pages: extract.page_contacts(pages),
    lambda pages: extract.candidates(extract.page_signals(pages), ["page_id"]),
    lambda pages: graph.link_targets(extract.page_contacts(pages)),
])
def test_html_is_tokenized_once(spark, make):
    assert plan(make(scan(spark))).count("regexp_extract_all(coalesce(html") == 1


@pytest.mark.parametrize("name", ["page_contacts", "html_text", "set_operations", "validation_funnel", "contact_dedup"])
def test_no_exchange_carries_html(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    for line in text.split("\n"):
        if "Exchange" in line:
            assert "RoundRobin" not in line and "html" not in line


def test_html_column_is_pruned(spark):
    assert "html" not in plan(queries.seed_urls(spark, SF)).split("ReadSchema: struct<page_id")[1][:40]


def test_link_targets_are_narrow(spark):
    assert "Exchange" not in plan(graph.link_targets(extract.page_contacts(scan(spark))))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def above(text: str, table: str) -> list[str]:
    """Operators from the top of a plan down to the scan of a table."""
    lines = [line for line in text.split("\n") if line.strip()]
    at = next(i for i, line in enumerate(lines) if f".{table}[" in line)
    found, width = [], len(lines[at])
    for line in reversed(lines[: at + 1]):
        indent = len(line) - len(line.lstrip(" :+-*"))
        if indent < width:
            found.append(line)
            width = indent
    return found


def test_a_round_moves_neither_visited_pages_nor_edges(spark, no_broadcast):
    with RunTables(spark) as run:
        row = spark.range(1000).select(F.concat(F.lit("https://s"), F.col("id") % 3, F.lit(".ru")).alias("seed_url"), F.concat(F.lit("https://s.ru/"), "id").alias("url"))
        key = ["seed_url", "url"]
        rows = row.withColumns({"used": F.lit(1).cast("bigint"), "depth": F.lit(0).cast("bigint"), "step": F.lit(0)}).repartition(run.n_buckets, *key)
        assert run.append(rows, "visited", "step", *key) == 1000
        edges = row.select(F.col("url").alias("src_url"), F.concat("url", F.lit("/x")).alias("dst_url"), F.lit("s.ru").alias("host"), F.lit(1).alias("length"))
        edges = run.save_bucketed(edges, "edges", "src_url")
        visited = run.table("visited")
        for found in (
            graph.closer_pages(row.withColumn("depth", F.lit(0).cast("bigint")), edges, visited),
            graph.new_in_level(row.withColumn("used", F.lit(1)), edges, visited),
        ):
            path = above(plan(found), "visited")
            assert any("Join" in line for line in path) and not any("Exchange" in line for line in path)
            path = above(plan(found), "edges")
            assert not any("Exchange" in line for line in path[: next(i for i, line in enumerate(path) if "LeftSemi" in line)])
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_parts_of_sites_need_no_array_of_a_site(spark, no_broadcast):
    with RunTables(spark) as run:
        rows = spark.range(10).select(F.lit("s").alias("seed_url"), F.lit("email").alias("kind"), F.lit("a@b.cd").alias("value"))
        text = plan(reports.contact_parts(rows, run, 100))
        assert "collect_set" not in text and "keys=[seed_url" in text


def test_filters_stay_behind_the_shuffle_of_the_keys(spark):
    """What is made of a key is filtered by all tasks, not by the few that read the keys."""
    for rows in (queries.seeds(spark, SF), queries.all_pages(spark, SF).filter(F.octet_length("html") < 5000), queries.raw_contacts(spark, SF).filter("phone > '1'")):
        text = plan(rows)
        assert "REPARTITION_BY_NUM" in text
        assert "Filter (" not in text.split("REPARTITION_BY_NUM")[1] and "Filter (" in text


def test_links_are_parsed_once(spark):
    """Hosts and edges both come from the table of links."""
    seeds = spark.createDataFrame([("https://a.ru",)], "seed_url string")
    with RunTables(spark) as run:
        text = plan(graph.edges_on_sites(graph.link_targets(extract.page_contacts(scan(spark))), seeds, run))
        assert ".targets[" in text and "regexp_extract_all(coalesce(html" not in text
