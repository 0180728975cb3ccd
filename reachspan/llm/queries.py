"""Queries over the synthetic tables, one for each operator of this subpackage, and SQL for some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, bpe, conversations, decontaminate, licences, lines, ngram_join, rules, spelling, suffix_array, tokens, toxicity, warc
from ._spark import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digest(suffix_array.remove_repeats(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rules.judge(documents, rules.fit(documents, table(spark, sf_dir, "labels")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.report(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(ngram_join.join(table(spark, sf_dir, "documents")))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.digest(automata.remove_repeats(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(damaged), damaged)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_token_count, op3_suffix_array_dedup, op4_quality_rules, op5_byte_bpe, op6_line_dedup, op7_decontamination, op8_ngram_join, op9_arc_to_warc, op10_substring_dedup, op11_spelling_variants, op12_toxicity, op13_conversation_repair)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The table of crc32, and the checksum of a list of bytes by it.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(text: str) -> str:
    """Of a text of ASCII and U+00C0 to U+00FF, beside the table."""
    data = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten({data})), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295)"


_SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
l AS (SELECT doc_id, translate(r, '{_UPPER}', '{_UPPER.lower()}') AS r, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT r, k, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM l, crc),
o AS (SELECT k, CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
v AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
UNION SELECT v.word, w.word FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.rest = w.word),
q AS (SELECT p.word, count(*) AS n_near, min({{'a': -n, 'b': other}}) AS best FROM p JOIN w ON w.word = p.other GROUP BY p.word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 5 * n THEN best END AS best FROM w LEFT JOIN q USING (word)),
c AS (SELECT word, word AS last, 0 AS k FROM f UNION ALL SELECT c.word, f.best.b, k + 1 FROM c JOIN f ON f.word = c.last WHERE f.best IS NOT NULL)
SELECT f.word, f.best.b AS form, root, n, n_near, -f.best.a AS form_n FROM f JOIN (SELECT word, arg_max(last, k) AS root FROM c GROUP BY word) USING (word)"""


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, initial: str, cost: str, put: str = "") -> str:
    """A way (cost, audit, repaired rows) with one more edit."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'o': {state}.o{put and f' || {put}'}}} END"


def _repair_sql() -> str:
    """The four states' least ways (cost, audit, output), row by row, all conversations at once."""
    line = lambda role, text: f"{role} || ':' || {text} || chr(10)"
    user, assistant = line("'user'", "''"), line("'assistant'", "''")

    def closed(inner: str) -> str:
        """Ways with inserts added, of those in columns s0 to s3."""
        two = _least("s2", *(_edit(q, "I", "3", user) for q in ("s0", "s1", "s3")))
        three = _least("s3", _edit("s2", "I", "3", assistant))
        return f"SELECT * REPLACE ({three} AS s3) FROM (SELECT * REPLACE ({two} AS s2) FROM ({inner}))"

    def into(to: str, initial: str, froms: tuple[str, ...], role: str) -> str:
        ways = [_edit(to, "D", "4")]
        for q in froms:
            ways.append(f"CASE WHEN f < 2 AND x = '{initial}' THEN {_edit(q, 'K', '3 * f', line('role', 'text'))} END")
            if role:
                ways.append(f"CASE WHEN f < 2 THEN {_edit(q, 'R', '3 + 3 * f', line(role, 'text'))} END")
        return f"{_least(*ways)} AS n{to[1]}"

    step = f"SELECT conv_id, rn, s0, s1, s2, s3, {_edit('s0', 'D', '4')} AS n0, {into('s1', 's', ('s0',), '')}, {into('s2', 'u', ('s0', 's1', 's3'), chr(39) + 'user' + chr(39))}, {into('s3', 'a', ('s2',), chr(39) + 'assistant' + chr(39))} FROM (SELECT w.conv_id, r.rn, r.role, r.text, r.f, r.x, w.s0, w.s1, w.s2, w.s3 FROM w JOIN r ON r.conv_id = w.conv_id AND r.rn = w.rn + 1)"
    start = "SELECT conv_id, CAST(0 AS BIGINT) AS rn, {'c': CAST(0 AS BIGINT), 'a': '', 'o': ''} AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS s1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS s2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn, left(role, 1) AS x FROM d),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 3 WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 0 ELSE 1 END AS f, x || lead(x) OVER (PARTITION BY conv_id ORDER BY rn) AS xx FROM o),
w AS ({closed(start)} UNION ALL {closed(f"SELECT conv_id, rn, n0 AS s0, n1 AS s1, n2 AS s2, n3 AS s3 FROM ({step})")}),
e AS (SELECT conv_id, arg_max({_least("s0", "s3")}, rn) AS best FROM w GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 2) AS blank, count(*) FILTER (WHERE f = 3) AS duplicate, count(*) FILTER (WHERE f = 1) AS truncated, count(*) FILTER (WHERE xx NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(left(best.o, greatest(length(best.o) - 1, 0))) AS repaired_sha256
FROM e LEFT JOIN g USING (conv_id)"""


ORACLE_SQL: dict[str, str] = {
    "op3_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d),
g AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM g JOIN f USING (k) WHERE first < doc_id),
s AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM s GROUP BY doc_id, run),
o AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM r UNION ALL SELECT doc_id, len(h) // 2, coalesce((SELECT max(e) FROM r WHERE r.doc_id = d.doc_id), 0) FROM d),
k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents), b AS (SELECT item_id, {_LOWERED} AS w FROM benchmark),
bp AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw)),
hit AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp) JOIN bw USING (n, g)),
q AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op9_arc_to_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM m""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d),
g AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (h) WHERE first < doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_spelling_variants": _SPELLING,
    "op13_conversation_repair": _repair_sql(),
}
