"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.llm.alignment import align_tokens
from postmill.llm.common import new_path, table
from postmill.llm.decontamination import contamination
from postmill.llm.languages import identify
from postmill.llm.license_scan import SLACK, TEMPLATES, WIDTH, scan_licenses
from postmill.llm.media import media_features
from postmill.llm.near_duplicates import near_duplicates
from postmill.llm.packing import pack_documents
from postmill.llm.periodic_runs import periodic_runs
from postmill.llm.quality import judge
from postmill.llm.secrets import ASSIGN, ASSIGN_LEAST, scan_secrets
from postmill.llm.sharding import PRIME, round_keys, shard_rows
from postmill.llm.token_counts import count_tokens
from postmill.llm.token_files import digests, write_tokens


def op1_flac_media(spark, sf_dir):
    """Every whole text as a FLAC stream in a media table, read back and verified; its stored PCM blocks, read back and described."""
    return media_features(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark, sf_dir):
    """Writes all documents' token ids to list columns in the shared folder and reads their digests back."""
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)


def op5_best_fit(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_feistel_shards(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))


def op8_positional_index(spark, sf_dir):
    """Exact windows of items by document, and in near_items the items that only nearly occur."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_passages(spark, sf_dir):
    """op8 for items whose every seventh word is changed: what quotes them exactly now does so nearly."""
    changed = F.array_join(F.transform(F.split("text", " "), lambda x, i: F.when(i % 7 == 6, F.lit("zzz")).otherwise(x)), " ")
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumn("text", changed)).select("doc_id", "n_hit", "n_items", "near_items")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP8 = f"""
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM items) x WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b) x),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM b) y) x),
hits AS (SELECT doc_id, p, n, item_id FROM places JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) x GROUP BY doc_id),
item_words AS (SELECT item_id, n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM b),
doc_words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
stands AS (SELECT DISTINCT doc_id, item_id, n, p - j + s AS a, j FROM doc_words JOIN item_words USING (x), (SELECT unnest(range(-3, 4)) AS s) y),
many AS (SELECT doc_id, item_id, n, a, list(j) AS js FROM stands GROUP BY ALL HAVING 5 * count(*) >= 4 * n),
runs AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, a ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM (SELECT doc_id, item_id, n, a, unnest(js) AS j FROM many) x),
near AS (SELECT doc_id, string_agg(i, ',' ORDER BY i) AS near_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM runs r WHERE 5 * c >= 4 * n AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = r.doc_id AND h.item_id = r.item_id)) x GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) x GROUP BY doc_id)"""
OP8_SQL = f"""
WITH items AS (SELECT * FROM benchmark), {_OP8}
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN near USING (doc_id)"""


NEAR_SQL = f"""
WITH items AS (SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i % 7 = 0 THEN 'zzz' ELSE x END), ' ') AS text FROM benchmark), {_OP8}
SELECT d.doc_id, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN near USING (doc_id)"""


def op9_superminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def secret_base_spans(spark, sf_dir):
    """op6's rows without what its structural confirmation adds."""
    return scan_secrets(table(spark, sf_dir, "documents")).drop("spans")


def _spans_sql(kind: str, place: int, pattern: str, least: int, group: int) -> str:
    """(doc_id, kind, place, a, b): matches of a pattern whose group is long enough, by what stands before and between them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, unnest(list_transform(m, lambda x, i: list_sum(list_transform(s[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0))) AS a, unnest(list_transform(m, lambda x: len(x))) AS n, unnest(list_transform(g, lambda x: len(x) >= {least})) AS long_enough
    FROM (SELECT doc_id, regexp_extract_all(t, $p${pattern}$p$) AS m, regexp_extract_all(t, $p${pattern}$p$, {group}) AS g, regexp_split_to_array(t, $p${pattern}$p$) AS s FROM d WHERE regexp_matches(t, $p${pattern}$p$)) x"""


BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT doc_id, kind, place, a, a + n AS b FROM (
  {_spans_sql("assign", 0, ASSIGN.pattern, ASSIGN_LEAST, 2)}
  UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]{16,}", 0, 0)}
  UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{24,}", 0, 0)}) y WHERE long_enough),
told AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, place) AS base FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN told USING (doc_id)"""


def _feistel_sql(x: str) -> str:
    """A select of (row, n, m, x) with the network applied once to the column x of `x`."""
    out = f"SELECT row, n, m, x // m AS l, x % m AS r FROM ({x}) f"
    for a, b, c in round_keys(20):
        out = f"SELECT row, n, m, r AS l, (l + ((r * r % {PRIME}) * {a} % {PRIME} + r * {b} % {PRIME} + {c}) % {PRIME} % m) % m AS r FROM ({out}) f"
    return f"SELECT row, n, m, l * m + r AS x FROM ({out}) f"


OP7_SQL = f"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM documents, crcs),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM d),
walk AS ({_feistel_sql("SELECT row, n, CAST(ceil(sqrt(n)) AS BIGINT) AS m, row AS x FROM numbered")} UNION ALL {_feistel_sql("SELECT row, n, m, x FROM walk WHERE x >= n")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 24 AS INTEGER) AS shard, x // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, numbered.row FROM numbered JOIN walk ON walk.row = numbered.row AND walk.x < walk.n"""


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


_TEMPLATES = ", ".join("({}, '{}', '{}', {}, {})".format(i, t.label, " ".join(t.text.split()).replace("'", "''"), t.share, t.phrase) for i, t in enumerate(TEMPLATES))
OP11_SQL = f"""
WITH texts(template, label, text, share, phrase) AS (VALUES {_TEMPLATES}),
t AS (SELECT template, label, share, phrase, w, len(w) AS n, least({WIDTH}, len(w)) AS k FROM (SELECT *, {_WORDS} AS w FROM texts) x),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
own AS (SELECT template, k, j, array_to_string(w[j + 1:j + k], ' ') AS g FROM (SELECT *, unnest(range(n - k + 1)) AS j FROM t) x),
grams AS (SELECT row, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT row, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM t) y) x),
votes AS (SELECT row, template, k, j, p, p - j AS diagonal FROM grams JOIN own USING (k, g)),
lines AS (SELECT row, template, diagonal, count(*) AS c FROM votes GROUP BY ALL),
phrases AS (SELECT row, label, diagonal AS s, diagonal + n AS e, CAST(1 AS DOUBLE) AS part, phrase FROM lines JOIN t USING (template) WHERE phrase AND c = n - k + 1),
apart AS (SELECT row, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= n / CAST({SLACK} AS DOUBLE) THEN 0 ELSE 1 END AS new FROM lines JOIN t USING (template) WHERE NOT phrase),
clusters AS (SELECT row, template, diagonal, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS c FROM apart),
covered AS (SELECT row, template, c, unnest(range(j, j + k)) AS j, unnest(range(p, p + k)) AS p FROM votes JOIN clusters USING (row, template, diagonal)),
spans AS (SELECT row, label, s, e, a / n AS part, phrase FROM (SELECT row, template, c, count(DISTINCT j) AS a, count(DISTINCT p) AS b, min(p) AS s, max(p) + 1 AS e FROM covered GROUP BY ALL) x JOIN t USING (template) WHERE 100 * a >= share * n AND 2 * b >= e - s),
found AS (SELECT * FROM phrases UNION ALL SELECT * FROM spans),
told AS (SELECT row, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) AS first_word, max(s) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score FROM found GROUP BY row),
places AS (SELECT row, string_agg(label || ':' || s || ':' || e, ',' ORDER BY s, e, label) AS spans FROM (SELECT DISTINCT row, label, s, e FROM found) x GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row) LEFT JOIN places USING (row)"""


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2) p WHERE 100 * c >= 80 * (n - c)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, near.y FROM reach JOIN near ON near.x = reach.r)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


def queries():
    return {f.__name__: f for f in (op1_flac_media, op2_language_id, op3_quality, op4_token_files, op5_best_fit, op6_secret_scan, op7_feistel_shards, op8_positional_index, op9_superminhash, op10_token_counts, op11_license_scan, op12_periodic_runs, op13_token_alignment, near_passages, secret_base_spans)}


def oracle_sql():
    return {"op8_positional_index": OP8_SQL, "op9_superminhash": OP9_SQL, "near_passages": NEAR_SQL, "secret_base_spans": BASE_SQL, "op7_feistel_shards": OP7_SQL, "op11_license_scan": OP11_SQL}
