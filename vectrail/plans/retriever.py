"""Question answering over stored vectors and articles: embed, search, look up."""

from pyspark.sql import DataFrame

from vectrail.functions.text import QUERY_PREFIX
from vectrail.operators.batch_search import Rounds, search_batch
from vectrail.operators.embedding import MakeModel, embed_queries
from vectrail.operators.lookup import attach_documents
from vectrail.operators.search import search, with_rank
from vectrail.schema import DOC_ID, DOCUMENT_COLUMNS, QUERY_ID, RANK, SIMILARITY

RESULT_COLUMNS = [QUERY_ID, RANK, DOC_ID, SIMILARITY, *DOCUMENT_COLUMNS]


class Retriever:
    """Searches a vector table with text queries and returns the articles found.

    ``vectors`` holds float or int8 vectors. ``scoring`` goes to the search: ``metric``, ``clamp``,
    ``eps``, ``on_nan`` and ``norm_column``. ``rounds`` goes to searches of many queries.
    """

    def __init__(
        self,
        vectors: DataFrame,
        articles: DataFrame,
        model: MakeModel,
        *,
        query_prefix: str = QUERY_PREFIX,
        rounds: Rounds | None = None,
        **scoring,
    ):
        self.vectors = vectors
        self.articles = articles
        self.model = model
        self.query_prefix = query_prefix
        self.rounds = rounds
        self.scoring = scoring

    def embed_query(self, text: str) -> list[float]:
        """The vector of one query."""
        spark = self.vectors.sparkSession
        queries = spark.createDataFrame([(0, text)], f"{QUERY_ID} bigint, text string")
        return embed_queries(queries, self.model, prefix=self.query_prefix).head()[1]

    def search(self, text: str, k: int = 10, num_records: int | None = None) -> DataFrame:
        """The ``k`` best articles for one query, by rank."""
        found = search(
            self.vectors, self.embed_query(text), k, num_records=num_records, **self.scoring
        )
        hits = with_rank(found).selectExpr(f"0L AS {QUERY_ID}", RANK, DOC_ID, SIMILARITY)
        return self._result(hits)

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` best articles for each ``(query_id, text)``, by query and rank."""
        embedded = embed_queries(queries, self.model, prefix=self.query_prefix)
        hits = search_batch(self.vectors, embedded, k, rounds=self.rounds, **self.scoring)
        return self._result(hits)

    def _result(self, hits: DataFrame) -> DataFrame:
        found = attach_documents(hits, self.articles)
        return found.select(*RESULT_COLUMNS).orderBy(QUERY_ID, RANK)
