"""The walk over pages that arrive: every micro-batch extends what is reached.

Links of the pages that arrive join the edge table. Seeds that had already reached one of these pages
go on from there, and the walk runs until nothing comes closer. Tables of edges and of reached
pages live in a run, in buckets, and only grow; what counts is the smallest depth. A batch that is
delivered again adds rows that change nothing.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.operators import graph
from contactlake.operators.extract import page_contacts
from contactlake.operators.run_tables import RunTables
from contactlake.settings import Settings
from contactlake.sources.pages import admitted_pages

KEY = ("seed_url", "url")


class ArrivingWalk:
    """Whole-site walks from ``seeds`` (column ``seed_url``), as pages arrive.

    Use ``add`` as the function of ``foreachBatch`` and read ``visited()`` at any time.
    """

    def __init__(self, seeds: DataFrame, run: RunTables, settings: Settings = Settings()):
        self.run, self.settings = run, settings
        self.seeds = run.save(seeds.select("seed_url").distinct(), "seeds")
        self.step = 0
        first = graph.seed_states(self.seeds).select(*KEY, F.lit(0).cast("bigint").alias("depth"))
        self._reach(first.repartition(run.n_buckets, *KEY))
        self.batches = 0

    def _reach(self, rows: DataFrame) -> int:
        return self.run.append(rows.withColumn("step", F.lit(self.step)), "reached", "step", *KEY)

    def visited(self) -> DataFrame:
        """``(seed_url, url, depth)`` by the pages that have arrived."""
        return self.run.table("reached").groupBy(*KEY).agg(F.min("depth").alias("depth"))

    def add(self, pages: DataFrame, batch_id: int = 0) -> None:
        """Take in pages ``(url, html, ...)``. Pages that arrive again add the links they have now."""
        run = self.run
        contacts = page_contacts(admitted_pages(pages).select("url", "html"), self.settings)
        links = graph.link_targets(contacts.withColumn("url", graph.page_key(F.col("url"))))
        links = graph.edges_on_sites(links, self.seeds, run).filter("src_url <> dst_url").withColumn("length", F.lit(1))
        new = run.save_bucketed(links, f"links_{self.batches}", "src_url")
        run.append(new.withColumn("batch", F.lit(self.batches)), "edges", "batch", "src_url")
        self.batches += 1
        found = graph.closer_pages(self.visited(), new, run.table("reached"))
        for _ in itertools.count():
            self.step += 1
            if not self._reach(found):
                return
            reached = run.table("reached")
            last = reached.filter(F.col("step") == self.step).drop("step")
            found = graph.closer_pages(last, run.table("edges").drop("batch"), reached)
