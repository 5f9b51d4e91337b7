"""A run from a configuration: source tables in, written tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lettermark.config import Config
from lettermark.operators import cohorts, graph
from lettermark.sources.tables import read_table, write_table


def run_cohorts(links: DataFrame, refs: DataFrame, aps: DataFrame, papers: DataFrame, config: Config, folder: str) -> dict[str, DataFrame]:
    """Letters, windowed impact, treated and comparison cohort as written tables below `folder`, read back by name.

    Impact is partitioned parquet; the others are ordered gzip text, a folder for each venue where there is one.
    """
    spark = papers.sparkSession
    done: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame, order_by: tuple[str, ...], format: str = "csv") -> DataFrame:
        write_table(df, f"{folder}/{name}", ("venue",), order_by, format)
        done[name] = read_table(spark, f"{folder}/{name}", name, format)
        return done[name]

    letters = keep("letter_metadata", cohorts.resolve_links(links, papers), ("original_id", "letter_id"))
    edges = graph.union_refs(refs, aps, papers)
    horizons = range(1, config.horizons + 1)
    impact = keep("paper_impact", graph.windowed_impact(edges, papers, config.venues, horizons, config.start_year), ("id",), "parquet")
    years = config.min_references, config.start_year, config.end_year
    keep("agg_letters", cohorts.treated_cohort(letters, impact, *years), ("original_id",))
    keep("agg_nonletters", cohorts.control_cohort(impact, letters, *years), ("id",))
    return done
