"""Pages as bytes, redirects, runs that are written again, nested codes, pages that arrive."""

import shutil

import pytest
from pyspark.sql import functions as F

from contactlake.functions import charsets
from contactlake.operators import graph, lookup_joins, sites
from contactlake.operators.run_tables import RunTables
from contactlake.plans import queries
from contactlake.settings import Settings
from contactlake.sources import pages as page_source
from contactlake.sources import sinks
from contactlake.streaming.walk import ArrivingWalk

TEXT = "<p>Größe: 5 €, Привет, Ελλάδα, žluť, 漢字, 😀</p>"
META = '<html><head><meta charset="{}"></head>{}'
FETCHED = [
    # body, content type, charset, text
    (TEXT.encode(), None, "utf-8", TEXT),
    (b"\xef\xbb\xbf" + TEXT.encode(), "text/html; charset=windows-1251", "utf-8", TEXT),
    (b"\xff\xfe" + TEXT.encode("utf-16-le"), "text/html; charset=utf-8", "utf-16le", TEXT),
    (b"\xfe\xff" + TEXT.encode("utf-16-be"), None, "utf-16be", TEXT),
    ("Привет".encode("cp1251"), "text/html;charset=CP1251", "windows-1251", "Привет"),
    ("Привет".encode("koi8-r"), "text/html; Charset = 'KOI8-R'", "koi8-r", "Привет"),
    ("Привет".encode("cp866"), "text/html; charset=ibm866", "ibm866", "Привет"),
    ("žluť €".encode("cp1250"), "text/html; charset=windows-1250", "windows-1250", "žluť €"),
    ("Ελλάδα".encode("iso-8859-7"), "text/html; charset=greek", "iso-8859-7", "Ελλάδα"),
    ("naïve €".encode("cp1252"), "text/html; charset=ISO-8859-1", "windows-1252", "naïve €"),
    (META.format("windows-1251", "Привет").encode("cp1251"), "text/html", "windows-1251", META.format("windows-1251", "Привет")),
    (META.format("utf-16", "é").encode(), None, "utf-8", META.format("utf-16", "é")),
    (META.format("koi8-u", "x").encode() + "Ї".encode("koi8-u"), "text/html; charset=no-such", "koi8-u", META.format("koi8-u", "x") + "Ї"),
    (b"<meta data-charset=koi8-r>caf\xe9", None, "windows-1252", "<meta data-charset=koi8-r>café"),
    (b" " * 1100 + b"<meta charset=koi8-r>", None, "utf-8", " " * 1100 + "<meta charset=koi8-r>"),
    (b"caf\xe9 \x80 \x81", None, "windows-1252", "café € �"),
    (b"a\xffb", "text/html; charset=utf-8", "utf-8", "a�b"),
    (b"\xff\xfea\x00\x00\xd8b\x00\x00\xdc", None, "utf-16le", "a�b�"),
    (b"\xff\xfea\x00x", None, "utf-16le", "a"),
    (b"", None, "utf-8", ""),
    (None, "text/html", None, None),
]


def test_bytes_in_many_charsets(spark):
    rows = [(i, None if b is None else bytearray(b), kind) for i, (b, kind, _, _) in enumerate(FETCHED)]
    frame = spark.createDataFrame(rows, "k long, body binary, content_type string")
    got = {r.k: (r.charset, r.html) for r in page_source.decoded_pages(frame).collect()}
    assert [got[i] for i in range(len(FETCHED))] == [(c, t) for _, _, c, t in FETCHED]
    plain = page_source.decoded_pages(frame.drop("content_type").filter("k = 0")).first()
    assert plain.html == TEXT


@pytest.mark.parametrize("name", [n for n in charsets.NAMES if n not in (charsets.UTF_8, charsets.UTF_16LE, charsets.UTF_16BE)])
def test_every_byte_of_a_charset(spark, name):
    body = bytes(range(256))
    codec = "cp866" if name == "ibm866" else name
    frame = spark.createDataFrame([(bytearray(body),)], "body binary")
    assert frame.select(charsets.decoded(F.col("body"), F.lit(name))).first()[0] == body.decode(codec, "replace")


def test_links_start_where_redirects_ended(spark):
    rows = [(1, "https://a.ru/x", '<a href="y">l</a>', "https://b.ru/p/q"), (2, "https://c.ru/x", '<a href="y">l</a>', None), (3, "https://d.ru/x", '<a href="y">l</a>', " ")]
    pages = page_source.at_final_url(spark.createDataFrame(rows, "page_id long, url string, html string, final_url string"))
    with RunTables(spark) as run:
        found = graph.link_targets(sites.extracted_pages(pages, run=run)).collect()
    assert sorted(r.dst_url for r in found) == ["https://b.ru/p/y", "https://c.ru/y", "https://d.ru/y"]
    assert sorted(r.requested_url for r in pages.collect()) == ["https://a.ru/x", "https://c.ru/x", "https://d.ru/x"]


def results(spark, *rows):
    return spark.createDataFrame([(*r, ["a@b.cd"] if r[1] else None, []) for r in rows], "url string, success boolean, emails array<string>, phones array<string>")


def test_a_run_counts_once_however_often_it_is_written(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    first = results(spark, ("https://a.ru", True), ("https://b.ru", False), ("x", True))
    assert sinks.write_run(first, path, "2024-01") == (3, 2, 1, 2, 0)

    with monkeypatch.context() as broken:  # the rows are written, the manifest is not
        broken.setattr(sinks, "_RUN", "broken")
        with pytest.raises(Exception):
            sinks.write_run(results(spark, ("https://c.ru", True)), path, "2024-02")
    assert sorted(r.url for r in sinks.read_runs(spark, path).collect()) == ["https://a.ru", "https://b.ru", "x"]
    sinks.write_run(results(spark, ("https://c.ru", True), ("https://d.ru", True)), path, "2024-02")
    sinks.write_run(first.filter("url <> 'x'"), path, "2024-01")  # again, with fewer rows
    sinks.write_run(results(spark, ("https://e.ru", True)), path, "1")
    sinks.write_run(results(spark, ("https://f.ru", True)), path, "01")
    rows = sinks.read_runs(spark, path)
    assert sorted((r.run, r.url) for r in rows.collect()) == [
        ("01", "https://f.ru"), ("1", "https://e.ru"), ("2024-01", "https://a.ru"), ("2024-01", "https://b.ru"), ("2024-02", "https://c.ru"), ("2024-02", "https://d.ru")
    ]
    manifest = {r.run: (r.total, r.failed) for r in sinks.read_manifest(spark, path).collect()}
    assert manifest == {"01": (1, 0), "1": (1, 0), "2024-01": (2, 1), "2024-02": (2, 0)}


def test_summary_of_what_was_written(spark, tmp_path):
    rows = results(spark, ("a", True), ("b", None), ("c", False))
    assert sinks.write_json(rows, str(tmp_path / "j")) == (3, 1, 2, 1, 0)
    assert sinks.write_json(rows.limit(0), str(tmp_path / "none")) == (0, 0, 0, 0, 0)


def test_candidates_count_themselves_while_they_are_written(spark, tmp_path):
    rows = [("phone", None), ("phone", "length"), ("phone", "length"), ("email", "no_at"), ("email", None), ("email", "never heard of")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "kind string, reason string, raw string")
    path = str(tmp_path / "c")
    want = {("phone", "valid"): 1, ("phone", "length"): 2, ("email", "no_at"): 1, ("email", "valid"): 1, ("email", "other"): 1}
    assert sinks.write_candidates(frame, path) == want and spark.read.parquet(path).count() == 6
    assert sinks.write_candidates(frame.limit(0), str(tmp_path / "none")) == {}


def test_longest_of_nested_codes(spark):
    codes = spark.createDataFrame([(c,) for c in ["7", "77", "770", "1", "1242", "1", "", None]], "code string")
    numbers = ["7", "78", "77", "7701", "7711", "1242", "124", "9", "", None]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "k long, digits string")
    got = {r.digits: r.code for r in lookup_joins.with_longest_prefix(frame, "digits", codes).collect()}
    want = {n: max((c for c in ["7", "77", "770", "1", "1242"] if (n or "").startswith(c)), key=len, default=None) for n in numbers}
    assert got == want
    assert {r.code for r in lookup_joins.with_longest_prefix(frame, "digits", codes.limit(0)).collect()} == {None}


def test_pages_that_arrive_give_the_rows_of_one_walk(spark):
    pages = [(i, f"https://c.ru/{i}", f'<a href="/{i * 2 + 1}">l</a><a href="/{i * 2 + 2}">r</a><a href="/{i - 3}">b</a>') for i in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://c.ru/0",), ("https://c.ru/4",), ("https://d.ru",)], "seed_url string")
    with RunTables(spark) as run, RunTables(spark) as other:
        want = {tuple(r) for r in sites.walk_sites(frame, seeds, Settings(max_pages=None), run).visited.collect()}
        arriving = ArrivingWalk(seeds, other)
        for i, part in enumerate(["page_id % 3 = 2", "page_id % 3 = 2", "page_id = 1000", "page_id % 3 = 1", "page_id % 3 = 0"]):
            arriving.add(frame.filter(part), i)
        rows = [tuple(r) for r in arriving.visited().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("files", [0, 3])
def test_the_page_table_as_a_stream_is_a_file_or_a_folder(spark, tmp_path, files):
    rows = [(i, f"https://c{i}.ru/", f"<p>Mail u{i}@mail.ru </p>") for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    if files:
        frame.repartition(files, "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    else:
        frame.coalesce(1).write.parquet(str(tmp_path / "one"))
        shutil.copy(next((tmp_path / "one").glob("*.parquet")), tmp_path / "pages.parquet")
        frame.limit(1).write.parquet(str(tmp_path / "more_pages.parquet"))
    got = queries.contacts_from_stream(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.site, r.kind, r.value) for r in got) == [(i, f"c{i}.ru", "email", f"u{i}@mail.ru") for i in range(9)]


def test_batches_of_a_stream_see_the_tables_of_their_own_batch(spark, tmp_path):
    """Batches run in a session of their own, the walk reads in the one of its seeds."""
    rows = [(i, f"https://c.ru/{i}", f'<a href="/{i + 1}">n</a>') for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in range(3):
        frame.filter(f"page_id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with RunTables(spark) as run:
        arriving = ArrivingWalk(spark.createDataFrame([("https://c.ru/0",)], "seed_url string"), run)
        state = stream.writeStream.foreachBatch(arriving.add).option("checkpointLocation", str(tmp_path / "state"))
        state.trigger(availableNow=True).start().awaitTermination()
        assert arriving.batches == 3
        assert sorted((r.url, r.depth) for r in arriving.visited().collect()) == [(f"https://c.ru/{i}", i) for i in range(10)]
