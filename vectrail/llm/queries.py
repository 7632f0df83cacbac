"""One query per operator, over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import (
    ann_scan,
    best_fit,
    chat_format,
    cube_mix,
    filter_audit,
    html_consensus,
    itq_dedup,
    jaccard_join,
    lang_cnn,
    quality_fm,
    suffix_dedup,
    toxicity_pu,
    turn_repair,
)
from vectrail.llm.registry import ORACLES, QUERIES, query, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Where the vocabulary of the packing query lies."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def label_column(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the labels, as ``(doc_id, label)``."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))


@query()
def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return ann_scan.search(table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


@query()
def op2_quality_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    labels = label_column(spark, sf_dir, "quality")
    return quality_fm.classify_quality(table(spark, sf_dir, "documents"), labels)


@query()
def op3_language_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = lang_cnn.predict_languages(docs)
    return found.select("doc_id", "held_out", "lang_pred", "score")


#: Shingles of words, pairs that link, and the smallest doc_id that links reach.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), every AS (
  SELECT doc_id, unnest(CASE WHEN coalesce(len(words), 0) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i : i + 2], ' ') FOR i IN range(1, len(words) - 1)] END) AS shingle
  FROM w
), s AS (SELECT DISTINCT doc_id, shingle FROM every
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id
FROM documents AS d JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query(OP4_SQL)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies by three-word shingles."""
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


@query()
def op5_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.9 or more."""
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: The same turns and examples in SQL; the template's marks are those of chat_format.
OP7_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *,
    row_number() OVER w AS nth,
    count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(replace(replace(text, '\', '\b'), '<|', '\l'))
      + length(replace(replace(role, '\', '\b'), '<|', '\l')) + 23) OVER w AS upto
  FROM every
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR nth = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query(OP7_SQL)
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that speaks of control strings, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    examples = chat_format.format_examples(turns.unionByName(extra))
    return chat_format.conversation_digest(examples)


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings that earlier ones hold."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op9_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    labels = label_column(spark, sf_dir, "toxic")
    return toxicity_pu.classify_toxicity(table(spark, sf_dir, "documents"), labels)


@query()
def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    return cube_mix.mix(table(spark, sf_dir, "documents"))


#: Pages of this layout in SQL: the lines of the article element, without tags and decoded.
OP11_SQL = r"""
WITH lines AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'),
    '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS raw FROM pages
), decoded AS (
  SELECT page_id, url, list_filter(list_transform(raw, lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(x, '&quot;', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS blocks FROM lines
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text,
  length(array_to_string(blocks, chr(10))) AS n_chars FROM decoded
"""


@query(OP11_SQL)
def op11_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, at the paths that the pages of its host agree on."""
    return html_consensus.extract_pages(table(spark, sf_dir, "pages"))


#: The same damage, faults and edits in SQL: one step of the recursion for each row of a conversation.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT byte, xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS tab FROM bits WHERE k = 8
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT) AS name
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295::BIGINT] || name,
    lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1]))) % 20 AS fate
  FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM fated, range(2) AS c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier
  FROM placed
), convs AS (SELECT DISTINCT conv_id FROM conversations
), stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), follows(initial, state, next) AS (
  VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), inserted(state, next, cost, edits) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'),
    (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')
), best AS (
  SELECT conv_id, 0::BIGINT AS pos, next AS state, lpad(cost::VARCHAR, 9, '0') || edits AS value
  FROM convs, inserted WHERE state = 0
  UNION ALL
  SELECT conv_id, pos, next, min(value) FROM (
    SELECT b.conv_id, f.pos, i.next,
      lpad((left(b.value, 9)::INT + e.cost + i.cost
        + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END)::VARCHAR, 9, '0')
      || substr(b.value, 10) || e.edit || i.edits AS value
    FROM best AS b JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1
    JOIN (
      SELECT s.state, s.state AS next, 4 AS cost, 'D' AS edit, '' AS initial FROM range(4) AS s(state)
      UNION ALL SELECT state, next, 0, 'K', initial FROM follows
      UNION ALL SELECT state, next, 3, 'R', '' FROM follows WHERE initial <> 's'
    ) AS e ON e.state = b.state AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
      AND (e.edit <> 'K' OR e.initial = f.initial)
    JOIN inserted AS i ON i.state = e.next
  ) GROUP BY conv_id, pos, next
), ended AS (
  SELECT c.conv_id, coalesce(any_value(s.n), 0) AS n, min(value) AS value
  FROM convs AS c LEFT JOIN stats AS s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = coalesce(s.n, 0) AND b.state IN (0, 3)
  GROUP BY c.conv_id
), audits AS (
  SELECT conv_id, left(value, 9)::BIGINT AS cost, substr(value, 10) AS audit FROM ended
), edits AS (
  SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS nr, unnest(string_split(audit, '')) AS edit
  FROM audits WHERE audit <> ''
), numbered AS (
  SELECT conv_id, nr, edit, count(*) FILTER (edit <> 'I') OVER w AS pos FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY nr)
), said AS (
  SELECT m.conv_id, m.nr, m.edit, f.role, f.text,
    count(*) FILTER (NOT (m.edit = 'K' AND f.initial = 's')) OVER (PARTITION BY m.conv_id ORDER BY m.nr) AS nth
  FROM numbered AS m LEFT JOIN faults AS f
    ON m.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos
  WHERE m.edit <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nr)) AS sha FROM said GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  coalesce(r.sha, sha256('')) AS repaired_sha256
FROM audits AS a LEFT JOIN stats AS s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query(OP12_SQL)
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation with its faults and its cheapest repair."""
    return turn_repair.repair_conversations(turn_repair.damage(table(spark, sf_dir, "conversations")))


#: Every document's failed filters, counted directly for every part, order and step.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t
), m AS (
  SELECT doc_id, part,
    (len(words) < 100)::INT AS a,
    (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e
  FROM w
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT m.part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS n
  FROM m LEFT JOIN said ON said.doc_id = m.doc_id
), orders AS (
  SELECT '' AS filter_order
  UNION ALL SELECT filter_order || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
  WHERE NOT contains(filter_order, x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS x, filter_order[:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), seen AS (
  SELECT DISTINCT x, list_sort(string_split(earlier, '')) AS before FROM steps
), patterns AS (
  SELECT part, fails, n, good, bad, count(*) AS docs FROM f GROUP BY ALL
), counted AS (
  SELECT part, x, before,
    sum(docs) FILTER (fails[x] = 0 AND NOT early) AS kept,
    sum(docs) FILTER (fails[x] = 1 AND NOT early) AS removed,
    sum(docs) FILTER (fails[x] = 1 AND early) AS redundant,
    sum(docs) FILTER (fails[x] = 1 AND n = 1) AS unique_fails,
    sum(docs) FILTER (fails[x] = 1 AND NOT early AND good = 1) AS good_lost,
    sum(docs) FILTER (fails[x] = 1 AND NOT early AND bad = 1) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda y: y <> '' AND fails[y] = 1)) > 0 AS early
    FROM patterns, seen) GROUP BY part, x, before
), report AS (
  SELECT part, filter_order, step, x, coalesce(kept, 0)::BIGINT AS kept,
    coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
    coalesce(toxic_lost, 0)::BIGINT AS toxic_lost
  FROM steps JOIN counted USING (x)
  WHERE counted.before = list_sort(string_split(steps.earlier, ''))
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM report
"""


@query(OP13_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each language in every order."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
