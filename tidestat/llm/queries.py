"""One query for each operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestat.llm import audio, bpe, centroids, chat, decontaminate, html_extract, jaccard_join, licenses, line_dedup, prefix_trie, secrets, substring_dedup, toxicity
from tidestat.llm.common import materialise


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(_table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


def op2_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def tokenizer() -> bpe.Tokenizer:
    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer(), keep_text=False, keep_tokens=False, digests=True)


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, d, "labels"), HELD_OUT)
    scored = toxicity.score(docs, model).withColumn("held_out", F.expr(HELD_OUT))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(_table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "digest", "license", F.array_join("notices", ",").alias("notices")
    )


def op8_media_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of stand-in recordings, one for each vector of `embeddings`; queries are those with ids divisible by 100.

    A row for every recording (and block of queries) with the list of queries that it aligns with, empty where there is none."""
    media = _table(spark, d, "embeddings").select("vec_id", "embedding")
    found = materialise(audio.fingerprints(media, "embedding", audio.render).select("vec_id", "fingerprint"), "fingerprints")
    out = audio.align(found, found.where("vec_id % 100 = 0"), "vec_id")
    return out.select(F.col("id").alias("vec_id"), "block", F.col("matches.query_id").alias("query_ids"), "matches")


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, _table(spark, d, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, d, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    out = substring_dedup.dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return secrets.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op12_conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("conv_id") - F.col("conv_id") % 5
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(_table(spark, d, "conversations"), base, kept)


CENTROIDS, ROUNDS = 40, 5


def op13_centroid_clustering(spark: SparkSession, d: str) -> DataFrame:
    out = centroids.cluster(_table(spark, d, "embeddings"), k=CENTROIDS, rounds=ROUNDS)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_media_fingerprints": op8_media_fingerprints,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": pipeline,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _canonical_sql(text: str) -> str:
    out = f"replace(translate(regexp_replace({text}, '{licenses.COPYRIGHT_LINE}', '', 'g'), {_LOWER}), '&', ' and ')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
    for a, b in licenses.EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _values(known: tuple[tuple[str, str], ...]) -> str:
    quoted = lambda x: x.replace("'", "''").replace(chr(10), "' || chr(10) || '")
    return ", ".join(f"('{k}', '{quoted(v)}')" for k, v in known)


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string; its table follows from the polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(CAST({table} AS BIGINT[])[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


_TRIE = f"""WITH rows AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  t AS (SELECT c, sym, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sym) AS p FROM
    (SELECT c, turn, strlen(text) AS n, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS sym FROM rows)),
  ids AS (SELECT c, c - c % 5 AS g, {_crc32_sql('CAST(c AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT c FROM rows)),
  head AS (SELECT i.c, t.p, t.sym, t.n FROM ids i JOIN t ON t.c = i.g AND t.p <= i.h),
  own AS (SELECT i.c, 8 + t.p AS p, t.sym, t.n FROM ids i JOIN t ON t.c = i.c AND t.p > i.h),
  full_ AS (SELECT ids.c, coalesce(s, []) AS s, coalesce(w, []) AS w FROM ids LEFT JOIN
    (SELECT c, list(sym ORDER BY p) AS s, list(n ORDER BY p) AS w FROM (SELECT * FROM head UNION ALL SELECT * FROM own) GROUP BY c) r USING (c)),
  each AS (SELECT c, s, w, unnest(range(0, len(s) + 1)) AS d FROM full_),
  nodes AS (SELECT array_to_string(s[1:d], ' ') AS k, d, min(c) AS conv_id, count(*) AS n, any_value(s[1:d]) AS s, coalesce(any_value(CASE WHEN d > 0 THEN w[d] END), 0) AS bytes,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends FROM each GROUP BY 1, 2),
  kids AS (SELECT array_to_string(s[1:d - 1], ' ') AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
  known AS (SELECT nodes.*, coalesce(kids.n, 0) AS kids FROM nodes LEFT JOIN kids USING (k, d)),
  sums AS (SELECT array_to_string(s[1:e], ' ') AS k, e AS d, sum((n - 1) * bytes) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY 1, 2)"""


def _clustering_sql() -> str:
    """Lloyd's rounds written out, one after the other."""
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        """x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM
          (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x ORDER BY h NULLS LAST, v LIMIT {CENTROIDS}))""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x.v) AS v, CAST(min(CAST({square} AS HUGEINT) * {CENTROIDS} + c.k) AS HUGEINT) AS m FROM x CROSS JOIN c{i} c GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
              (SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT m % {CENTROIDS} AS k, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY 1) n ON n.k = c.k)""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c.k AS INT) AS cluster, CAST(a.m // {CENTROIDS} AS BIGINT) AS distance,
      CAST(sum(a.m // {CENTROIDS}) OVER (PARTITION BY c.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.m // {CENTROIDS}) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.m % {CENTROIDS}"""


ORACLE: dict[str, str] = {
    "op12_conversation_trie": _TRIE + """ SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, sums.leaves AS n_leaves,
      CAST(sums.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256 FROM known x JOIN sums USING (k, d) LEFT JOIN nodes up ON x.d > 0 AND up.d = x.d - 1 AND up.k = array_to_string(x.s[1:x.d - 1], ' ')""",
    "op13_centroid_clustering": _clustering_sql(),
    "op2_chat_formatting": r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
      f AS (SELECT *, CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 8 WHEN 'assistant' THEN 13 WHEN 'tool' THEN 8 ELSE length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ')', '\)')) + 10 END + 2
          + length(replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ')', '\)')) + 9 AS n,
          lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(n) AS BIGINT) AS formatted_chars,
        bool_and((before = 'start' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant')
          OR (before = 'assistant' AND role IN ('user', 'tool')) OR (before = 'tool' AND role IN ('assistant', 'tool'))) AS valid
      FROM f GROUP BY conv_id""",
    "op6_line_dedup": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
      l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
      k AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS key FROM l),
      g AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
      SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (g.key IS NOT NULL AND g.first <> k.doc_id) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.key IS NULL OR g.first = k.doc_id), '')) AS kept_sha256
      FROM k LEFT JOIN g ON g.key = k.key GROUP BY k.doc_id, k.r""",
    "op7_benchmark_decontamination": rf"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
      b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
      bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS key FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
      sizes AS (SELECT DISTINCT n FROM bw),
      dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS key FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w CROSS JOIN sizes WHERE len(ws) >= n)),
      h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, key)),
      hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
      items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""",
    "op10_substring_dedup": rf"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
      g AS (SELECT doc_id, r, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS key FROM (SELECT doc_id, r, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
      f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first, min(i) OVER (PARTITION BY key, r) AS own FROM g),
      gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM f WHERE first < doc_id OR own < i)),
      e AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
      k AS (SELECT e.r, count(*) FILTER (gone.p IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY e.p) FILTER (gone.p IS NULL) AS kept FROM e LEFT JOIN gone ON gone.r = e.r AND gone.p = e.p GROUP BY e.r)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)""",
    "op9_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
      t AS (SELECT DISTINCT r, hash(array_to_string(ws[i:i + 2], ' ')) AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
      n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
      p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
      e AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
      two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
      reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, two.b FROM reach JOIN two ON two.a = reach.b),
      c AS (SELECT reach.a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY 1)
      SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (r) JOIN c USING (r)""",
    "op5_license_scan": f"""WITH known(license, digest) AS (SELECT min(k), d FROM (SELECT k, sha256({_canonical_sql('t')}) AS d FROM (VALUES {_values(licenses.TEXTS)}) v(k, t)
          UNION ALL SELECT * FROM (VALUES {_values(licenses.DIGESTS)}) w(k, d)) GROUP BY 2),
      notes(license, digest) AS (SELECT min(k), sha256({_canonical_sql('t')}) FROM (VALUES {_values(licenses.NOTICES)}) v(k, t) GROUP BY 2),
      d AS (SELECT doc_id, row_number() OVER () AS r, text, sha256({_canonical_sql('text')}) AS digest FROM documents),
      l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
      n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN notes ON digest = sha256({_canonical_sql('line')}) GROUP BY r)
      SELECT d.doc_id, d.digest, known.license, coalesce(n.notices, '') AS notices FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (r)""",
}
