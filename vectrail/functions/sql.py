"""The vector functions in SQL: scalar functions inside the plan, and a table function for top k."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from vectrail.functions.scorers import check_metric, prepare_queries, similarities
from vectrail.functions.similarity import EPSILON, SCORE_DECIMALS
from vectrail.schema import DOC_ID, DOC_VECTOR, SIMILARITY

_V = "ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with(v, q, (x, y) -> x * y), 0D, (t, p) -> t + p)"
_NORM = "sqrt(aggregate(transform({0}, x -> x * x), 0D, (t, s) -> t + s))"
#: Name, parameters, result and body; arrays of floats or codes are widened by Spark.
SCALARS = [
    ("vector_dot", f"v {_V}, q {_V}", "DOUBLE", _DOT),
    ("vector_norm", f"v {_V}", "DOUBLE", _NORM.format("v")),
    ("vector_normalize", f"v {_V}", _V, "IF(vector_norm(v) = 0, NULL, transform(v, x -> x / vector_norm(v)))"),
    ("vector_cosine", f"v {_V}, q {_V}", "DOUBLE", f"vector_dot(v, q) / greatest(vector_norm(v) * vector_norm(q), {EPSILON}D)"),
    (
        "vector_code",
        f"v {_V}, low DOUBLE, high DOUBLE",
        "ARRAY<TINYINT>",
        "transform(v, x -> IF(high > low, CAST(least(greatest(CAST((CAST(x AS FLOAT) - CAST(low AS FLOAT)) / "
        "(CAST(high AS FLOAT) - CAST(low AS FLOAT)) AS FLOAT) * 255F - 128F, -128F), 127F) AS TINYINT), CAST(-128 AS TINYINT)))",
    ),
]
# Rows scored at a time.
_ROWS = 4096


class VectorTopK:
    """``vector_topk(TABLE(...), query, k)``: the k rows of each task nearest to a query by cosine.

    The table has ``doc_id`` and ``doc_vector``; its other columns are returned too, the vector is
    not. A fourth argument 'dot' takes the dot product. Rows without a vector are left out, and an
    undefined score fails. A task holds k rows and some thousand vectors, so the whole table never
    meets in one; ``ORDER BY similarity DESC, doc_id LIMIT k`` picks among the tasks' rows. With
    ``PARTITION BY (column)`` the k best of each group are returned.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, query: AnalyzeArgument, k: AnalyzeArgument, metric: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or not {DOC_ID, DOC_VECTOR} <= set(table.dataType.names):
            raise ValueError(f"vector_topk needs TABLE(...) with {DOC_ID} and {DOC_VECTOR}")
        if not isinstance(table.dataType[DOC_VECTOR].dataType, T.ArrayType) or not isinstance(query.dataType, T.ArrayType):
            raise ValueError("vectors and the query must be arrays")
        if not k.isConstantExpression or k.value is None or k.value < 1:
            raise ValueError("k must be a positive constant")
        if metric is not None:
            check_metric(metric.value, "product")
        others = [f for f in table.dataType.fields if f.name != DOC_VECTOR]
        schema = T.StructType([*others, T.StructField(SIMILARITY, T.DoubleType())])
        return AnalyzeResult(schema, select=[SelectedColumn(f"`{n}`") for n in table.dataType.names])

    def __init__(self):
        self.rows, self.vectors, self.best, self.query = [], [], [], None

    def eval(self, row, query, k, metric="cosine"):
        if self.query is None:
            self.query, self.k = prepare_queries(np.array([query]), metric, "product", EPSILON), k
            names = row.__fields__
            self.at, self.id = names.index(DOC_VECTOR), names.index(DOC_ID)
        vector = row[self.at]
        if vector is None:
            return
        if len(vector) != len(self.query.columns):
            raise ValueError(f"every vector must have {len(self.query.columns)} values, found {len(vector)}")
        self.rows.append(row)
        self.vectors.append(vector)
        if len(self.rows) == _ROWS:
            self._score()

    def _score(self) -> None:
        scores = np.round(similarities(np.array(self.vectors, dtype=np.float64), self.query)[:, 0], SCORE_DECIMALS)
        if np.isnan(scores).any():
            raise ValueError("undefined similarity")
        self.best += zip(scores.tolist(), self.rows)
        # A NULL id comes first among equals, as in ORDER BY.
        self.best.sort(key=lambda b: (-b[0], b[1][self.id] is not None, b[1][self.id] or 0))
        del self.best[self.k :]
        self.rows, self.vectors = [], []

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            self._score()
        for score, row in self.best:
            yield (*row[: self.at], *row[self.at + 1 :], score)


def register_sql(spark: SparkSession) -> None:
    """Add ``vector_dot``, ``vector_norm``, ``vector_normalize``, ``vector_cosine``, ``vector_code``
    and ``vector_topk`` to the session. The package must be shipped to the executors."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("vector_topk", udtf(VectorTopK))
