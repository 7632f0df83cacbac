"""Times the headline queries and prints one line of JSON.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_COPIES
(default 100): how many copies of the vector table make the table of 768 dimensions for the search
rates, 0 to leave that out.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tests.session import local_session  # noqa: E402
from vectrail.deploy import ship  # noqa: E402
from vectrail.operators.batch_search import search_batch  # noqa: E402
from vectrail.operators.quantize import quantize_table, vector_range  # noqa: E402
from vectrail.operators.search import search  # noqa: E402
from vectrail.plans.build import build_articles  # noqa: E402
from vectrail.plans.catalog import QUERIES  # noqa: E402
from vectrail.plans.catalog.standins import raw_fields, vectors, write_xml  # noqa: E402
from vectrail.scratch import new_path  # noqa: E402
from vectrail.sources.article_xml import read_articles  # noqa: E402
from vectrail.sources.tables import write_vectors  # noqa: E402
from vectrail.streaming.incremental import ingest_new_files, read_ingested  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
COPIES = int(os.environ.get("BENCH_COPIES", "100"))
RUNS = 2

HEADLINE = [
    "topk_search",
    "topk_packed",
    "topk_dot",
    "batch_topk",
    "search_with_documents",
    "topk_int8",
    "score_table",
    "vector_range",
    "quantize_table",
    "embed_documents",
    "retrieve_documents",
    "masked_mean_pool",
    "dedup_first_wins",
    "upsert_ignore",
    "raw_vector_import",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_of(make, runs: int = RUNS) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run(make())
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def wide_table(spark):
    """Every vector ``COPIES`` times, at different lengths, twelve times over: 768 dimensions."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    parts = [
        F.transform("doc_vector", lambda x, i=i: (x * (1 + F.col("copy") % (7 + i))).cast("float"))
        for i in range(12)
    ]
    copies = vectors(spark, SF_DIR).withColumn("copy", copy)
    return copies.select(
        (F.col("doc_id") * COPIES + F.col("copy")).alias("doc_id"),
        F.flatten(F.array(*parts)).alias("doc_vector"),
    ).repartition(4 * CPUS)


def search_rates(spark) -> dict[str, float]:
    """Seconds for exact searches over the wide table, in the storage forms there are."""
    paths = {kind: new_path(spark, kind) for kind in ("array", "packed", "codes")}
    write_vectors(wide_table(spark), paths["array"])
    table = spark.read.parquet(paths["array"])
    write_vectors(table, paths["packed"], packed=True)
    write_vectors(quantize_table(table, vector_range(table)), paths["codes"], packed=True)
    query = table.where("doc_id = 0").head()["doc_vector"]
    queries = table.where(f"doc_id % {COPIES} = 0 AND doc_id < {COPIES} * 100").selectExpr(
        "doc_id AS query_id", "doc_vector AS query_vector"
    )
    packed = spark.read.parquet(paths["packed"])
    seconds = {
        f"search_768_{kind}": best_of(lambda p=path: search(spark.read.parquet(p), query, 5), 3)
        for kind, path in paths.items()
    }
    seconds["search_768_100_queries"] = best_of(lambda: search_batch(packed, queries, 5), 3)
    seconds["quantize_768"] = best_of(lambda: quantize_table(table, vector_range(table)))
    return seconds


def ingest_times(spark) -> dict[str, float]:
    """Seconds from XML files to the article table, in one batch and as a stream."""
    xml = new_path(spark, "xml")
    fields = raw_fields(spark, SF_DIR).drop("doc_id", "lang")
    write_xml(fields, xml)
    write_xml(fields, xml, compression="gzip")

    def stream():
        table, ledger = new_path(spark, "ingested"), new_path(spark, "ledger")
        ingest_new_files(spark, xml, table, ledger)
        return read_ingested(spark, table)

    return {
        "xml_read": best_of(lambda: read_articles(spark, xml)),
        "xml_to_articles": best_of(lambda: build_articles(spark, xml, new_path(spark, "articles"))),
        "xml_stream": best_of(stream),
    }


def main() -> None:
    spark = local_session(CPUS, memory="16g")
    ship(spark)
    # Python workers start with the first query; that is not what is measured.
    run(QUERIES["topk_search"](spark, SF_DIR))
    queries = {name: best_of(lambda n=name: QUERIES[n](spark, SF_DIR)) for name in HEADLINE}
    queries |= ingest_times(spark)
    result = {
        "metric": "headline queries, total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "cpus": CPUS,
    }
    if COPIES:
        rows = vectors(spark, SF_DIR).count() * COPIES
        seconds = search_rates(spark)
        result["queries"] |= seconds
        result["wide_rows"] = rows
        result["vectors_per_sec_768"] = {
            kind: round(rows / seconds[f"search_768_{kind}"]) for kind in ("array", "packed", "codes")
        }
        result["scores_per_sec_768_100_queries"] = round(100 * rows / seconds["search_768_100_queries"])
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
