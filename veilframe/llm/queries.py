"""One query per operator over the given tables, and plain SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, chat, counts, exact, language, merkle, mixing, packing, quality, simhash, topk, warc, whitening
from veilframe.llm.batches import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like marks of a template.
MARKED = r"\### Assistant: </turn> ok"


def op2_chat(spark, sf_dir):
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(MARKED).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.examples(turns.unionByName(marked)))


def bpe_digests(tokens: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of encoded and decoded texts."""
    return tokens.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        *more,
    )


def op3_bpe(spark, sf_dir):
    return bpe_digests(bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary()))


def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark, sf_dir):
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(
        F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), ""
    )
    return found.select("record_id", "url_key", "status", "response_id", headers.alias("headers"), F.sha2("body", 256).alias("body_sha256"))


def op6_exact(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("copies_taken")


def op9_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings")).drop("whole_score")


def op10_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_packing(spark, sf_dir):
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The rows whose text is changed after the manifest was made.
TAMPERED = "crc32(cast(doc_id as string)) % 3 = 0"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle(spark, sf_dir):
    claimed = F.when(F.expr(TAMPERED), F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    found = merkle.proofs(table(spark, sf_dir, "documents"), claimed={"text": claimed})
    proof = merkle.hashed(merkle.siblings(F.col("steps"))).alias("proof_sha256")
    told = found.select("doc_id", "leaf", "subroot", "root", proof, merkle.folded(F.col("claim"), F.col("steps")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    made = (
        op1_simhash, op2_chat, op3_bpe, op4_quality, op5_warc, op6_exact, op7_language, op8_mixing, op9_topk, op10_counts,
        op11_packing, op12_merkle, op13_whitening,
    )
    return {query.__name__: query for query in made}


CHAT = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'
), placed AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    sum(15 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;'))
      + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) OVER (w ROWS UNBOUNDED PRECEDING) AS shown
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR nth = n_turns THEN shown ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

WARC = r"""
WITH spelled AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://(www\.)?', '', 'i') AS plain FROM pages
), parted AS (
  SELECT page_id, html, regexp_extract(plain, '^[^?]*') AS place, regexp_extract(plain, '\?(.*)$', 1) AS query FROM spelled
), keyed AS (
  SELECT page_id, html,
    regexp_replace(lower(regexp_extract(place, '^[^/]*')), ':(80|443)$', '')
      || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '') AS page,
    list_sort(list_filter(string_split(query, '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)', 'i'))) AS kept
  FROM parted
), records AS (
  SELECT page_id AS p, html, page || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key,
    html || '<!-- changed -->' AS changed, html || '<!-- twin -->' AS twin
  FROM keyed
), tagged AS (
  SELECT *, '"' || md5(coalesce(html, '')) || '"' AS tag0, '"' || md5(coalesce(changed, '')) || '"' AS tag1,
    '"' || md5(coalesce(twin, '')) || '"' AS tag2, 'day ' || p % 28 AS day0, 'day ' || (p + 1) % 28 AS day1, 'day ' || (p + 2) % 28 AS day2
  FROM records
), full_responses AS (
  SELECT 8 * p AS id, url_key, p AS seen, html AS body, CASE WHEN p % 5 <> 0 THEN tag0 END AS tag, day0 AS day FROM tagged
  UNION ALL SELECT 8 * p + 1, url_key, p + 2, changed, CASE WHEN p % 5 <> 0 THEN tag1 END, day1 FROM tagged WHERE p % 3 = 2
  UNION ALL SELECT 8 * p + 2, url_key, p + 2, twin, CASE WHEN p % 5 <> 0 THEN tag2 END, day2 FROM tagged WHERE p % 7 = 0
), revisits AS (
  SELECT p, 8 * p + 3 AS id, url_key, CASE WHEN p % 6 = 0 THEN p - 1 ELSE p + 2 END AS seen, tag0 AS tag, day0 AS day FROM tagged
  UNION ALL SELECT p, 8 * p + 4, url_key, p + 7,
    CASE WHEN p % 11 = 0 THEN '"new"' WHEN p % 7 = 0 THEN tag2 WHEN p % 3 = 2 THEN tag1 ELSE tag0 END,
    CASE WHEN p % 7 = 0 THEN day2 WHEN p % 3 = 2 THEN day1 ELSE day0 END FROM tagged
  UNION ALL SELECT p, 8 * p + 5, url_key, p + 40, tag0, day0 FROM tagged
), shown AS (
  SELECT id, url_key, seen, CASE WHEN p % 5 <> 0 AND p % 10 <> 3 THEN tag END AS tag, CASE WHEN p % 10 <> 3 THEN day END AS day FROM revisits
), met AS (
  SELECT v.*, r.id AS found, r.body, r.tag AS found_tag, r.day AS found_day
  FROM shown v LEFT JOIN full_responses r ON v.url_key = r.url_key AND r.seen < v.seen
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY r.seen DESC NULLS LAST, r.id DESC) = 1
), judged AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_response'
    WHEN tag IS NOT NULL AND found_tag IS NOT NULL THEN CASE WHEN tag = found_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN day IS NOT NULL AND found_day IS NOT NULL THEN CASE WHEN day = found_day THEN 'resolved' ELSE 'mismatch' END
    ELSE 'no_validator' END AS status
  FROM met
), told AS (
  SELECT *, status = 'resolved' AS ok FROM judged
)
SELECT id AS record_id, url_key, status, found AS response_id,
  CASE WHEN ok THEN coalesce('content-length: ' || length(body) || chr(10), '') || 'content-type: text/html' || chr(10)
    ELSE 'content-length: 0' || chr(10) END
  || 'date: ' || seen || chr(10)
  || coalesce('etag: W/' || tag || chr(10), CASE WHEN ok THEN 'etag: ' || found_tag || chr(10) END, '')
  || coalesce('last-modified: ' || day || chr(10), '') AS headers,
  CASE WHEN ok THEN sha256(body) END AS body_sha256
FROM told
"""

EXACT = """
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER alike AS keep_id, count(*) OVER alike AS group_size,
  doc_id = max(doc_id) OVER alike AS kept, text_sha256
FROM texts WINDOW alike AS (PARTITION BY text_sha256)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE source_no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most,
    sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget
  FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted
), goals AS (
  SELECT *, least(most::DOUBLE, max(CASE WHEN level < most::DOUBLE / weight THEN level END) OVER () * weight::DOUBLE) AS target
  FROM levels
), queued AS (
  SELECT d.doc_id, d.size, g.source_no, g.source_size, g.target, floor(g.budget)::BIGINT AS budget,
    greatest(1, floor(g.target / 1000))::BIGINT AS quantum, row_number() OVER () AS row_no,
    sum(d.size) OVER (PARTITION BY g.source_no ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, done - size + copy * source_size AS start FROM queued, (VALUES (0), (1)) AS twice(copy) WHERE size > 0
), packets AS (
  SELECT *, start + nth * quantum AS first, least(quantum, size - nth * quantum) AS words
  FROM (
    SELECT *, unnest(range(ceil(least(size::DOUBLE, target - start) / quantum)::BIGINT)) AS nth FROM copies WHERE start < target
  )
), ordered AS (
  SELECT *, sum(words) OVER (ORDER BY (first + words) / target, source_no, first, words ROWS UNBOUNDED PRECEDING) AS total FROM packets
), served AS (
  SELECT row_no, sum(greatest(0, least(words, budget - (total - words))))::BIGINT AS taken FROM ordered GROUP BY row_no
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN served USING (row_no)
"""

TOPK = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.vector, v.vector)::BIGINT AS score
  FROM vectors q JOIN vectors v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


# Levels written out below: enough for 8^8 rows of a language and 8^3 languages.
_DEEP, _WIDE = 8, 3


def _levels(name: str, key: str, count: int) -> str:
    """Nodes of the levels of a tree as tables ``name``0, ``name``1 ..., with what stands before and after each in its run."""
    out = []
    for level in range(count):
        out.append(f"""{name}{level}_runs AS (
  SELECT *,
    CASE WHEN size > 1 THEN coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS before,
    CASE WHEN size > 1 THEN coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS after
  FROM {name}{level} WINDOW w AS (PARTITION BY {key}, place // 8 ORDER BY place)
), {name}{level + 1} AS (
  SELECT {key}, place // 8 AS place, CASE WHEN min(size) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest,
    (min(size) + 7) // 8 AS size
  FROM {name}{level} GROUP BY {key}, place // 8
)""")
    return ", ".join(out)


def _merkle_sql() -> str:
    fields = lambda text: " || ".join(
        f"coalesce(strlen({one}::VARCHAR) || ':' || {one}::VARCHAR, '-')" for one in ("doc_id", "source", "lang", "n_chars", text)
    )
    steps = [(f"n{level}_runs", "s.lang IS NOT DISTINCT FROM h.lang AND s.place = h.place", 8**level) for level in range(_DEEP)]
    steps += [(f"t{level}_runs", "s.place = h.lang_no", 8**level) for level in range(_WIDE)]
    told = "held0 AS (SELECT r.*, g.place AS lang_no, g.digest AS subroot, '' AS proof0, r.claim AS f0 FROM rows r JOIN t0 g ON g.lang IS NOT DISTINCT FROM r.lang)"
    for number, (runs, same, width) in enumerate(steps):
        told += f""", held{number + 1} AS (
  SELECT h.* EXCLUDE (proof{number}, f{number}), proof{number} || coalesce(s.before || s.after, '') AS proof{number + 1},
    CASE WHEN s.before IS NULL THEN f{number} ELSE sha256(s.before || f{number} || s.after) END AS f{number + 1}
  FROM held{number} h JOIN {runs} s ON {same} // {width}
)"""
    last = len(steps)
    return rf"""
WITH marked AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS state
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256({fields("text")}) AS leaf, sha256({fields("changed")}) AS claim
  FROM (SELECT *, CASE WHEN xor(state, 4294967295) % 3 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS changed FROM marked)
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM hashed
), n0 AS (SELECT lang, place, leaf AS digest, size FROM rows),
{_levels("n", "lang", _DEEP)},
t0 AS (
  SELECT 0 AS top, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, digest, count(*) OVER () AS size FROM n{_DEEP}
), {_levels("t", "top", _WIDE)},
{told}
SELECT doc_id, leaf, subroot, t{_WIDE}.digest AS root, sha256(proof{last}) AS proof_sha256, f{last} AS folded_root, f{last} = t{_WIDE}.digest AS verified
FROM held{last}, t{_WIDE}
"""


def oracles() -> dict[str, str]:
    return {"op2_chat": CHAT, "op5_warc": WARC, "op6_exact": EXACT, "op8_mixing": MIXING, "op9_topk": TOPK, "op12_merkle": _merkle_sql()}
