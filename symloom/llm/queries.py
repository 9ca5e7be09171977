"""The registered queries of the corpus operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import ann, bpe, codebooks, exact_dedup, mixing, passages, repair, sharding, simhash, substrings, tokenfiles, toxicity, warc
from symloom.llm.common import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.fuzzy_passages(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that op10_mixing aims at for each source."""
    docs = table(spark, sf_dir, "documents")
    return mixing.targets(docs.groupBy("source").agg(F.sum(word_count("text")).alias("source_size")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_bpe, op3_warc, op4_suffix_array, op5_simhash, op6_toxicity, op7_ann, op8_exact_dedup, op9_substring_dedup, op10_mixing, op11_conversation_repair, op12_vector_codes, op13_token_files, mix_targets)
    return {f.__name__: f for f in own}


EXACT_DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE octet_length(body) >= 100 GROUP BY digest)
SELECT p.page_id, octet_length(p.body)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND octet_length(p.body) >= 100
"""


TARGETS_SQL = r"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS full_size FROM s),
f AS (SELECT *, full_size / weight AS level, sum(full_size) OVER up AS filled, sum(weight) OVER up AS closed FROM w WINDOW up AS (ORDER BY full_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT level, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - (filled - full_size) AS rest, (SELECT sum(weight) FROM w) - (closed - weight) AS open_weight FROM f),
t AS (SELECT rest, open_weight FROM l WHERE rest / open_weight <= level ORDER BY level LIMIT 1)
SELECT source, source_size, coalesce(least(full_size, (SELECT rest FROM t) * weight / (SELECT open_weight FROM t)), full_size) AS target FROM w
"""


#: Row by row from the front: the cheapest audit to each state, inserted rows after each row included. The checksum is
#: made byte by byte from a table that is made bit by bit.
REPAIR_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
o AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT o.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda x, b: xor(x // 256, t[(xor(x, b) % 256 + 1)::INT])), 4294967295::BIGINT) % 20 AS kind FROM o, tab),
r0 AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
r1 AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM r0),
r AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM r1),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY c),
moves(st, x, nxt) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
one AS (SELECT st, nxt FROM moves WHERE x <> 's'),
ins AS (SELECT st, st AS nxt, 0 AS price, '' AS letters FROM (SELECT DISTINCT st FROM moves) UNION ALL SELECT st, nxt, 5, 'I' FROM one UNION ALL SELECT a.st, b.nxt, 10, 'II' FROM one a JOIN one b ON b.st = a.nxt WHERE a.st <> b.nxt),
edit AS (SELECT st, nxt, 'K' AS letter, 0 AS price, x FROM moves UNION ALL SELECT st, nxt, 'R', 1, NULL FROM moves WHERE x <> 's' UNION ALL SELECT DISTINCT st, st, 'D', 2, NULL FROM moves),
cells AS (
  SELECT c, 0::BIGINT AS i, nxt AS st, {'cost': price::BIGINT, 'audit': letters} AS best FROM sums, ins WHERE ins.st = ''
  UNION ALL
  SELECT c, i, st, min(best) AS best FROM (
    SELECT r.c, r.i, ins.nxt AS st, {'cost': (cells.best.cost + edit.price + ins.price + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'audit': cells.best.audit || letter || letters} AS best
    FROM cells JOIN r ON r.c = cells.c AND r.i = cells.i + 1 JOIN edit ON edit.st = cells.st AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edit.x IS NULL OR edit.x = r.initial) JOIN ins ON ins.st = edit.nxt) GROUP BY c, i, st),
done AS (SELECT cells.c, min(best) AS best FROM cells JOIN sums ON sums.c = cells.c AND cells.i = sums.n WHERE st IN ('', 'a') GROUP BY cells.c),
l0 AS (SELECT c, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS p FROM done),
l1 AS (SELECT c, p, audit[p] AS letter, sum(CASE WHEN audit[p] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY p) AS i FROM l0),
l2 AS (SELECT l1.c, letter, r.role, r.text, row_number() OVER w AS q, first_value(letter = 'K' AND r.initial = 's') OVER w AS system FROM l1 LEFT JOIN r ON r.c = l1.c AND r.i = l1.i AND letter <> 'I' WHERE letter <> 'D' WINDOW w AS (PARTITION BY l1.c ORDER BY p)),
l3 AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (q % 2 = 1) <> system THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY q) AS body FROM l2 GROUP BY c)
SELECT DISTINCT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM o LEFT JOIN sums ON sums.c = o.c LEFT JOIN done ON done.c = o.c LEFT JOIN l3 ON l3.c = o.c
"""


def codebooks_sql() -> str:
    """Assignments and means of two rounds and the last assignment, for vectors of 16 parts of four components."""
    far = " + ".join(f"(p.c[{k}] - b.c[{k}]) * (p.c[{k}] - b.c[{k}])" for k in (1, 2, 3, 4))
    means = ", ".join(f"floor(sum(c[{k}])::DOUBLE / count(*))::BIGINT" for k in (1, 2, 3, 4))
    assigned = f"SELECT id, part, any_value(c) AS c, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.id, p.part, p.c, b.entry, {far} AS d FROM p JOIN b{{n}} b ON p.part = b.part) GROUP BY id, part"
    moved = f"SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{{n}} b LEFT JOIN (SELECT part, entry, [{means}] AS c FROM a{{n}} GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry"
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, part, list_transform(embedding[part * 4 + 1 : part * 4 + 4], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM kept, range(16) AS t(part)),
b0 AS (SELECT part, id - 1 AS entry, c FROM p WHERE id <= 64),
a0 AS ({assigned.format(n=0)}), b1 AS ({moved.format(n=0)}), a1 AS ({assigned.format(n=1)}), b2 AS ({moved.format(n=1)}), a2 AS ({assigned.format(n=2)}),
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS x, unnest([1, 2, 3, 4]) AS k FROM b2)),
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept ON kept.id = coded.id, books
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": EXACT_DEDUP_SQL, "op3_warc": WARC_SQL, "mix_targets": TARGETS_SQL, "op11_conversation_repair": REPAIR_SQL, "op12_vector_codes": codebooks_sql()}
