"""One query per operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, decontaminate, embedding_join, fingerprints, language_id, line_dedup, lm_scoring, minhash,
    packing, source_audit, substring_dedup, suffix_dedup, toxicity,
)
from .common import staged


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    """The vocabulary file that packing uses here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary(), capacity=4096, end_id=1)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return line_dedup.line_dedup(docs, host="source", max_ratio=0.05, min_pages=5)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(_documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminations(_documents(spark, sf_dir), benchmark, percent=80).drop("tie")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir), window=200, keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(_documents(spark, sf_dir), min_docs=3, top=200)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = conversation_repair.damaged(given)
    found = staged(conversation_repair.repairs(rows)).withColumnRenamed("conv_id", "_id")
    hashes = conversation_repair.digests(conversation_repair.repaired_rows(rows, found.withColumnRenamed("_id", "conv_id")))
    hashes = hashes.withColumnRenamed("conv_id", "_hash_id")
    every = given.select("conv_id").distinct()
    every = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(
        hashes, F.col("conv_id").eqNullSafe(F.col("_hash_id")), "left"
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(text=_LOWER)}, []) AS ws FROM documents),
sh AS (
  SELECT doc_id,
         CASE WHEN len(ws) = 0 THEN []
              WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct([array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)]) END AS s
  FROM w
),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sh
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
),
smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, component_id, sh.doc_id = component_id AS kept
FROM sh JOIN smallest ON sh.doc_id = smallest.a
""",
    "op6_line_dedup": """
WITH totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
once AS (
  SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS line
  FROM documents
),
boiler AS (
  SELECT o.source, o.line
  FROM (SELECT source, line, count(*) AS pages FROM once GROUP BY source, line) o
  JOIN totals t ON o.source IS NOT DISTINCT FROM t.source
  WHERE o.pages >= 5 AND o.pages > 0.05::DOUBLE * t.total
),
per_host AS (SELECT source, list(line) AS lines FROM boiler GROUP BY source),
marked AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)),
                     lambda x: trim(x) = '' OR NOT list_contains(coalesce(p.lines, []), x)) AS kept
  FROM documents d LEFT JOIN per_host p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
       coalesce(len(lines), 0) AS n_lines,
       coalesce(len(lines), 0) - coalesce(len(kept), 0) AS n_removed
FROM marked
""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS ws FROM documents),
win AS (
  SELECT doc_id, unnest(range(0, len(ws) - 49)) AS pos,
         unnest([md5(array_to_string(ws[i + 1 : i + 50], ' ')) for i in range(0, len(ws) - 49)]) AS x
  FROM w WHERE len(ws) >= 50
),
least_doc AS (SELECT x, min(doc_id) AS d FROM win GROUP BY x),
gone AS (
  SELECT DISTINCT doc_id, pos + unnest(range(0, 50)) AS i
  FROM win JOIN least_doc USING (x) WHERE doc_id > d
),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM w),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i
  GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op8_benchmark_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
iw AS (SELECT item_id, {_WORDS.format(text=_LOWER)} AS ws FROM benchmark),
items AS (SELECT item_id, ws, len(ws) AS m, least(len(ws), 5) AS k FROM iw WHERE len(ws) > 0),
ish AS (
  SELECT item_id, m, k, unnest([array_to_string(ws[i : i + k - 1], ' ') for i in range(1, m - k + 2)]) AS x FROM items
),
icount AS (SELECT item_id, m, k, x, count(*) AS c FROM ish GROUP BY ALL),
dsh AS (
  SELECT doc_id, k, len(ws) AS n, unnest(range(0, len(ws) - k + 1)) AS pos,
         unnest([array_to_string(ws[i + 1 : i + k], ' ') for i in range(0, len(ws) - k + 1)]) AS x
  FROM dw, (SELECT DISTINCT k FROM items) WHERE len(ws) >= k
),
hits AS (SELECT d.doc_id, i.item_id, i.m, i.k, d.n, d.pos FROM dsh d JOIN icount i ON d.x = i.x AND d.k = i.k),
starts AS (
  SELECT DISTINCT doc_id, item_id, m, k, s
  FROM (SELECT *, unnest(range(greatest(0, pos - (m - k)), least(pos, n - m) + 1)) AS s FROM hits)
),
held AS (
  SELECT s.doc_id, s.item_id, s.m, s.k, s.s, d.x, count(*) AS c
  FROM starts s JOIN dsh d ON s.doc_id = d.doc_id AND s.k = d.k AND d.pos BETWEEN s.s AND s.s + s.m - s.k
  GROUP BY ALL
),
scored AS (
  SELECT h.doc_id, h.item_id, h.m, h.m - h.k + 1 AS length, h.s, sum(least(h.c, i.c)) AS common
  FROM held h JOIN icount i ON h.item_id = i.item_id AND h.x = i.x
  GROUP BY ALL
)
SELECT doc_id, item_id, max(common::DOUBLE / (2 * length - common)::DOUBLE) AS similarity, count(*) AS n_windows,
       arg_max(s, (common * 1000000000 - s)) AS start, arg_max(m, (common * 1000000000 - s)) AS n_words
FROM scored WHERE 100 * common >= 80 * (2 * length - common)
GROUP BY doc_id, item_id
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
token AS (SELECT lang, source, row, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM token GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM token GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c, k.c AS lang_c
  FROM grp g JOIN kept k ON g.lang = k.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
),
size AS (SELECT lang, source, sum(c) AS n, count(*) AS v, sum(lang_c) AS lang_n FROM cell GROUP BY lang, source),
share AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (n + v) AS p,
         1 + (1000000000 * (lang_c + 1)) // (lang_n + v) AS q
  FROM cell JOIN size USING (lang, source)
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM share WHERE c > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE given AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
usable AS (
  SELECT * FROM given
  WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(x, lambda v: v <> 0)) > 0
),
pairs AS (
  SELECT a.row AS a, b.row AS b FROM usable a JOIN usable b ON a.row <> b.row AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9::DOUBLE
),
reach AS (
  SELECT row AS a, row AS b FROM given
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
least_id AS (SELECT r.a, min(g.vec_id) AS component_id FROM reach r JOIN given g ON r.b = g.row GROUP BY r.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM given LEFT JOIN counts ON counts.a = given.row JOIN least_id ON least_id.a = given.row
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
coded AS (
  SELECT *, xor(list_reduce(
           list_concat([4294967295::BIGINT], [unicode(c)::BIGINT for c in string_split(name, '')]),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                    lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS code
  FROM named
),
rows AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM coded WHERE code <> 0
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows
),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS later,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM ordered
),
follow(q, x) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
name_of(x, n) AS (VALUES ('u', 'user'), ('a', 'assistant')),
moves AS (
  SELECT q, q AS r, 'D' AS edit FROM (VALUES (''), ('s'), ('u'), ('a')) t(q)
  UNION ALL SELECT q, x, 'K' FROM follow
  UNION ALL SELECT q, x, 'R' FROM follow WHERE x <> 's'
),
inserted AS (
  SELECT q, q AS r, 0 AS k, []::VARCHAR[] AS lines FROM (VALUES (''), ('s'), ('u'), ('a')) t(q)
  UNION ALL
  SELECT i.q, f.x, k + 1, list_append(lines, n || ':')
  FROM inserted i JOIN follow f ON i.r = f.q JOIN name_of o ON o.x = f.x WHERE k < 2
),
best AS (
  SELECT c.conv_id, 0::BIGINT AS i, r AS q, {'cost': 3 * k::BIGINT, 'audit': repeat('I', k), 'lines': lines} AS least
  FROM (SELECT DISTINCT conv_id FROM conversations) c, inserted WHERE q = ''
  UNION ALL
  SELECT b.conv_id, p.i, n.r, min({
    'cost': b.least.cost + 3 * n.k + CASE edit WHEN 'D' THEN 4 ELSE (edit = 'R')::INT * 3 + cut::INT * 3 END,
    'audit': b.least.audit || edit || repeat('I', n.k),
    'lines': list_concat(b.least.lines, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                         ELSE [o.n || ':' || text] END, n.lines)})
  FROM best b JOIN placed p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.i = b.i + 1
  JOIN moves m ON m.q = b.q AND (edit = 'D' OR (NOT blank AND NOT later AND (edit = 'R' OR m.r = initial)))
  JOIN inserted n ON n.q = m.r LEFT JOIN name_of o ON o.x = m.r
  GROUP BY b.conv_id, p.i, n.r
),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND later) AS duplicate,
         count(*) FILTER (NOT blank AND NOT later AND cut) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed)
  GROUP BY conv_id
),
ends AS (
  SELECT b.conv_id, min(least) AS least
  FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
  WHERE b.i = coalesce(c.n, 0) AND b.q IN ('', 'a') GROUP BY b.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, least.cost::BIGINT AS cost, least.audit AS audit,
       sha256(array_to_string(least.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
""",
}
