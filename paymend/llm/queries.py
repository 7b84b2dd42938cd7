"""Named queries of this package: thin frames around the operators, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paymend.llm import (
    conversation_repair, decontaminate, exact_dedup, html_extract, jaccard_join, langid, license_scan, packing, prefix_trie, quality_classifier, quality_rules, url_filter, warc
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share nine tenths of their 3-word shingles."""
    return jaccard_join.jaccard_components(_table(spark, folder, "documents"), width=3, percent=90)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, and where."""
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return license_scan.scan_licences(_table(spark, folder, "documents")).drop("spans")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.filter_urls(_table(spark, folder, "pages"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path())


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.round_trip(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.languages(_table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counted rules and compression bands for every document."""
    return quality_rules.quality_report(_table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents with the same text, and the one that stays."""
    return exact_dedup.exact_groups(_table(spark, folder, "documents"), keep="largest")


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of conversations rebuilt with shared beginnings."""
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.sequences(_table(spark, folder, "conversations"))))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    return conversation_repair.repair_report(conversation_repair.damage(_table(spark, folder, "conversations")))


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_jaccard_join, op2_decontamination, op3_license_scan, op4_url_filter, op5_best_fit_packing,
        op6_html_extraction, op7_warc, op8_language_id, op9_quality_rules, op10_quality_classifier,
        op11_exact_dedup, op12_conversation_trie, op13_conversation_repair,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BIT = " + ".join(f"{16 >> k} * CAST(substr(b, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))



def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda a, b: {byte}), 4294967295)"


def _named(role: str, text: str) -> str:
    return f"sha256(octet_length(encode({role})) || ':' || {role} || {text})"


def _way(of: str, cost: str, letter: str, line: str) -> str:
    """An edit before the rest ``of`` a repair: (c)ost, (a)udit and (r)epaired lines."""
    return f"{{'c': {of}.c + {cost}, 'a': '{letter}' || {of}.a, 'r': {line} || {of}.r}}"


def _row_ways(state: int) -> str:
    own = "role || ':' || text || chr(10)"
    to = conversation_repair.NEXT[state]
    name = conversation_repair.NAME[to].decode()
    keeps = {**{k.decode(): v for k, v in conversation_repair.MOVE[state].items()}, "": state}
    kept = " ".join(f"WHEN free AND left(role, 1) = '{k}' THEN {_way(f'f{v}', 'extra', 'K', own)}" for k, v in keeps.items())
    moved = _way(f"f{to}", "extra + 3", "R", f"'{name}:' || text || chr(10)")
    return f"list_min([{_way(f'f{state}', '4', 'D', repr(''))}, CASE {kept} END, CASE WHEN free THEN {moved} END]) AS g{state}"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
#: Only what SQL expresses on whole tables; the others are tested against brute force.
ORACLES = {
    "op1_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
pairs AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT y, c FROM reached JOIN pairs ON x = d)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM reached LEFT JOIN sizes ON sizes.doc_id = d GROUP BY d
""",
    "op7_warc": f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
named AS (
  SELECT page_id, octet_length(encode(body)) AS n, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS b, max(page_id) OVER (PARTITION BY body) AS first FROM bodies
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_UPPER}234567', 1 + {_BIT}, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM named
""",
    "op4_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op12_conversation_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (
  SELECT conv_id, {_named('role', 'text')} AS digest, octet_length(encode(text)) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_named('role', 'text')}) AS place FROM t
), c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, place, digest, bytes FROM c JOIN o ON o.conv_id = base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, digest, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND place > h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY own, place) AS path, bytes FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM s GROUP BY 1, 2),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
costs AS (SELECT nodes.path, (n IS NULL)::BIGINT AS leaf, (n_convs - 1) * bytes AS saved FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT n.path, sum(leaf) AS leaves, sum(saved) AS saved FROM nodes n JOIN costs c ON starts_with(c.path, n.path) GROUP BY 1),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM s GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN kids k USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1))
""",
    "op13_conversation_repair": f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), kinds AS (SELECT *, {_named('role', 'text')} AS tie, {_crc32('name')} % 20 AS kind FROM src),
hurt AS (
  SELECT conv_id, turn, tie, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, tie, copy) AS nth,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin FROM hurt
), faults AS (
  SELECT *, CASE WHEN fin = '' THEN 1 WHEN nth > 1 THEN 2 WHEN fin NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         row_number() OVER o AS i, lag(left(role, 1)) OVER o || left(role, 1) AS pair FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, nth)
), told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1
), walk AS (
  SELECT s.conv_id, coalesce(n, 0) AS i, {{'c': 0, 'a': '', 'r': ''}} AS f0, {{'c': 6, 'a': 'II', 'r': {_USER} || {_ASSISTANT}}} AS f1,
         {{'c': 3, 'a': 'I', 'r': {_ASSISTANT}}} AS f2, {{'c': 0, 'a': '', 'r': ''}} AS f3
  FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN told ON s.conv_id IS NOT DISTINCT FROM told.conv_id
  UNION ALL
  SELECT conv_id, i - 1, list_min([g0, {_way('h2', '3', 'I', _USER)}]), list_min([g1, {_way('h2', '3', 'I', _USER)}]), h2, list_min([g3, {_way('g2', '3', 'I', _USER)}])
  FROM (
    SELECT *, list_min([g2, {_way('g3', '3', 'I', _ASSISTANT)}]) AS h2 FROM (
      SELECT conv_id, i, {', '.join(_row_ways(s) for s in range(4))} FROM (
        SELECT walk.conv_id, walk.i, f0, f1, f2, f3, role, text, fault IN (0, 3) AS free, CASE fault WHEN 3 THEN 3 ELSE 0 END AS extra
        FROM walk JOIN faults ON walk.conv_id IS NOT DISTINCT FROM faults.conv_id AND walk.i = faults.i))) WHERE i > 0
)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(f0.c AS BIGINT) AS cost, f0.a AS audit, sha256(left(f0.r, greatest(length(f0.r) - 1, 0))) AS repaired_sha256
FROM walk w LEFT JOIN told ON w.conv_id IS NOT DISTINCT FROM told.conv_id WHERE i = 0
""",
}
