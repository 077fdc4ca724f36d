"""Thin queries that apply the operators of this subpackage to whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, lm, minhash, mixing, preferences, quality, secrets, spelling, suffix, tokens, trie, vectors
from ._shared import materialise


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_decontaminate_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_embedding_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_mix_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"))


def op7_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_records(_read(spark, sf_dir, "documents"), tokenizer_path())


def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(preferences.turns_of(_read(spark, sf_dir, "conversations")), "turns")
    return preferences.format_pairs(turns, preferences.preference_pairs(turns))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def op13_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_quality_gam": op1_quality_gam,
        "op2_decontaminate_automaton": op2_decontaminate_automaton,
        "op3_embedding_int8": op3_embedding_int8,
        "op4_minhash_chosen_path": op4_minhash_chosen_path,
        "op5_mix_pfair": op5_mix_pfair,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_secret_battery": op7_secret_battery,
        "op8_license_join": op8_license_join,
        "op9_token_records": op9_token_records,
        "op10_preference_chat": op10_preference_chat,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_spelling_tiles": op12_spelling_tiles,
        "op13_elias_fano_lm": op13_elias_fano_lm,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

OP2 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOW}, {ALNUM}) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOW}, {ALNUM}) AS ws FROM benchmark),
g AS (
  SELECT item_id, least(10, len(ws)) AS k,
    unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS t
  FROM b WHERE len(ws) > 0),
d AS (
  SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i,
    unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS t
  FROM w, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k),
o AS (SELECT DISTINCT d.doc_id, d.i, d.k, g.item_id FROM d JOIN g ON d.t = g.t AND d.k = g.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS t FROM embeddings UNION SELECT r.v, l.y FROM r JOIN l ON r.t = l.x)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.x = m.vec_id) AS n_links, c.c AS component_id, m.vec_id = c.c AS kept
FROM embeddings m JOIN (SELECT v, min(t) AS c FROM r GROUP BY v) c ON c.v = m.vec_id
"""


def _op8() -> str:
    sets = licenses.template_sets(licenses.TEMPLATES, licenses.THRESHOLD)
    template = ", ".join(f"({t}, '{label}', {words!r}, {half})" for t, label, words, _, half in sets)
    phrase = ", ".join(f"('{label}', '{text}', {len(text.split())})" for label, text in licenses.PHRASES)
    num, den = licenses.THRESHOLD
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, {ALNUM}) AS ws FROM documents),
t(t, label, ts, half) AS (VALUES {template}),
p(label, phrase, n) AS (VALUES {phrase}),
o AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(ws) - n + 1), lambda i: array_to_string(ws[i + 1:i + n], ' ') = phrase)) AS i
  FROM d, p WHERE contains(array_to_string(ws, ' '), phrase)),
b AS (
  SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM o GROUP BY doc_id),
k AS (
  SELECT doc_id, half, unnest(list_transform(range(0, greatest(0, ceil((len(ws) - 2 * half) / half))::BIGINT + 1),
    lambda i: list_distinct(ws[i * half + 1:i * half + 2 * half]))) AS ks FROM d, (SELECT DISTINCT half FROM t) WHERE len(ws) > 0),
m AS (
  SELECT doc_id, label, len(list_intersect(ks, ts)) / len(ts) AS share FROM k JOIN t USING (half)
  WHERE len(list_intersect(ks, ts)) * {den} >= {num} * len(ts)),
l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s
  FROM (SELECT doc_id, label FROM o UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(b.s, '') AS base_labels, coalesce(l.s, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(x.share, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id)
"""


OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 - 49 AS n, b, substr(h, b * 200 + 1, 298) AS t FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 50) // 100)) AS b FROM d)),
w AS (SELECT doc_id, b * 100 + j AS i, substr(t, j * 2 + 1, 100) AS s FROM (SELECT doc_id, n, b, t, unnest(range(0, least(100, n - b * 100))) AS j FROM p)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN m USING (s) WHERE m.lo < w.doc_id),
n AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, run),
k AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM (
    SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d)),
t AS (SELECT doc_id, string_agg(substr(h, x * 2 + 1, (y - x) * 2), '' ORDER BY x) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans, sha256(unhex(t.kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP10 = """
WITH t AS (
  SELECT DISTINCT conv_id AS conv, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv, turn, role, length(text) AS chars, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM t),
f AS (
  SELECT conv, md5(arg_min(said, ROW(turn, role, md5(said)))) AS opening,
    sum(chars) FILTER (WHERE role = 'assistant')::BIGINT AS answer,
    max(turn) FILTER (WHERE role = 'assistant') AS own_turn, arg_max(said, ROW(turn, md5(said))) FILTER (WHERE role = 'assistant') AS own
  FROM s GROUP BY conv HAVING count(*) FILTER (WHERE role = 'assistant') > 0),
n AS (
  SELECT *, coalesce(lead(conv) OVER w, first_value(conv) OVER w) AS nconv FROM f WINDOW w AS (PARTITION BY left(opening, 1) ORDER BY opening, conv)),
q AS (
  SELECT n.*, f.opening = n.opening AS alike, n.answer > f.answer OR (n.answer = f.answer AND n.conv < f.conv) AS more, f.own AS reply
  FROM n JOIN f ON f.conv = n.nconv WHERE n.conv != n.nconv),
p AS (
  SELECT DISTINCT CASE WHEN more OR NOT alike THEN conv ELSE nconv END AS chosen, CASE WHEN more OR NOT alike THEN nconv ELSE conv END AS rejected,
    CASE WHEN NOT alike THEN own_turn END AS place, CASE WHEN NOT alike THEN own END AS own, CASE WHEN NOT alike THEN reply END AS reply FROM q),
b AS (
  SELECT chosen, rejected, 'chosen' AS side, turn, role, said FROM p JOIN s ON s.conv = p.chosen
  WHERE place IS NULL OR turn < place OR (turn = place AND role = 'assistant' AND said = own)
  UNION ALL SELECT chosen, rejected, 'rejected', turn, role, said FROM p JOIN s ON s.conv = p.rejected WHERE place IS NULL
  UNION ALL SELECT chosen, rejected, 'rejected', turn, role, said FROM p JOIN s ON s.conv = p.chosen WHERE turn < place
  UNION ALL SELECT chosen, rejected, 'rejected', place, 'assistant', reply FROM p WHERE place IS NOT NULL),
r AS (SELECT chosen, rejected, turn, role, said, count(*) AS sides, min(side) AS side FROM b GROUP BY ALL),
c AS (SELECT chosen, rejected, min(turn) AS cut FROM r WHERE sides < 2 GROUP BY ALL),
o AS (
  SELECT chosen, rejected, turn, role, said, unnest(CASE WHEN cut IS NULL OR turn < cut THEN ['prompt'] WHEN sides = 2 THEN ['chosen', 'rejected'] ELSE [side] END) AS part
  FROM r LEFT JOIN c USING (chosen, rejected))
SELECT chosen, rejected, part, turn, role, said, part != 'prompt' AND role = 'assistant' AS loss FROM o
"""

OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON r.t = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(t) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""

OP5 = f"""
WITH RECURSIVE k AS (SELECT doc_id, coalesce(source, '') AS source, md5(doc_id::VARCHAR) AS h FROM documents),
c AS (SELECT source, count(*) AS n FROM k GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, {mixing.ALPHA}) / sum(pow(n::DOUBLE, {mixing.ALPHA})) OVER () AS w FROM c),
l AS (SELECT list(w ORDER BY source) AS ws, list(source ORDER BY source) AS s, count(*) AS m, max(ceil(ceil(n / {mixing.BLOCK_DOCS}) / w - 1e-6)) AS slots FROM w),
p AS (
  SELECT -1::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS used, -1::BIGINT AS best FROM l
  UNION ALL
  SELECT t + 1, list_transform(used, lambda u, i: u + CASE WHEN i - 1 = nb % m THEN 1 ELSE 0 END), nb FROM (
    SELECT t, used, m, list_min(list_transform(ws, lambda x, i: CASE WHEN floor(used[i] / x + 1e-6) <= t + 1
      THEN ceil((used[i] + 1) / x - 1e-6)::BIGINT * m + i - 1 END))::BIGINT AS nb
    FROM p, l WHERE t < slots - 1)),
e AS (
  SELECT s[(best % m)::INT + 1] AS source, t AS slot, row_number() OVER (PARTITION BY best % m ORDER BY t) - 1 AS block
  FROM p, l WHERE t >= 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS k FROM k),
b AS (SELECT doc_id, source, k, k // {mixing.BLOCK_DOCS} AS block FROM r)
SELECT b.doc_id, b.source, b.block::BIGINT AS block, e.slot::BIGINT AS slot, row_number() OVER (ORDER BY e.slot, b.k) - 1 AS "position"
FROM b JOIN e USING (source, block)
"""

#: CRC-32 by its table of 256 remainders of the reversed polynomial, for texts of which ``{bytes}`` is the list of bytes.
CRC_TABLE = """c AS (
  SELECT list(r ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS r
    FROM range(256) AS t(i)))"""
CRC = "xor(list_reduce([4294967295::UBIGINT] || {bytes}, lambda a, x: xor(a >> 8, crc[((xor(a, x) & 255) + 1)::INT])), 4294967295::UBIGINT)"
BYTES = "list_transform(range(1, length({hex}), 2), lambda i: ((position(substr({hex}, i, 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr({hex}, i + 1, 1) IN '0123456789ABCDEF') - 1)::UBIGINT)"


def _crc(text: str) -> str:
    return CRC.format(bytes=BYTES.format(hex=f"hex(encode({text}))"))


OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, {_crc("conv_id::VARCHAR")} % {trie.CHOICES} AS h FROM (SELECT DISTINCT conv_id FROM t), c),
b AS (
  SELECT v.conv_id, t.k, t.role, t.text FROM v JOIN t ON t.conv_id = v.conv_id - v.conv_id % {trie.FAMILY} AND t.k <= h
  UNION ALL SELECT v.conv_id, t.k + 1000000, t.role, t.text FROM v JOIN t USING (conv_id) WHERE t.k > h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    md5(strlen(role) || ':' || role || text) AS mark FROM b),
p AS (
  SELECT conv_id, 0::BIGINT AS depth, 0::BIGINT AS words, '' AS node, NULL::VARCHAR AS parent FROM v
  UNION ALL SELECT s.conv_id, s.depth, s.words, md5(p.node || s.mark), p.node FROM p JOIN s ON s.conv_id = p.conv_id AND s.depth = p.depth + 1),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT node, depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY node, depth),
k AS (SELECT parent AS node, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (node)),
u AS (SELECT a.node, sum((f.kids = 0)::INT) AS leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN p a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.node),
x AS (SELECT p.node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN e USING (conv_id, depth) GROUP BY p.node)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n AS n_convs, f.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN u USING (node) LEFT JOIN x USING (node) LEFT JOIN n q ON q.node = f.parent
"""

OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT id, translate(run, '{UPPER}', '{LOWER}') AS w, count(*) AS n FROM r WHERE length(run) >= {spelling.LEAST_CHARS} GROUP BY ALL),
h AS (SELECT w, n, {_crc("id || ':' || w")} AS h FROM l, c),
m AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (
  SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word != b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
g AS (
  SELECT v.word, v.n, count(p.y) AS n_near, max(o.n) AS top, arg_min(o.word, ROW(-o.n, encode(o.word))) AS best
  FROM v LEFT JOIN p ON p.x = v.word LEFT JOIN v o ON o.word = p.y GROUP BY v.word, v.n),
f AS (SELECT word, n, n_near, CASE WHEN top >= {spelling.FACTOR} * n THEN best END AS form, CASE WHEN top >= {spelling.FACTOR} * n THEN top END AS form_n FROM g),
s AS (SELECT word, coalesce(form, word) AS at FROM f UNION SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL),
z AS (SELECT s.word, s.at AS root FROM s JOIN f ON f.word = s.at WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN z USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate_automaton": OP2,
        "op3_embedding_int8": OP3,
        "op4_minhash_chosen_path": OP4,
        "op5_mix_pfair": OP5,
        "op6_suffix_array_dedup": OP6,
        "op8_license_join": _op8(),
        "op10_preference_chat": OP10,
        "op11_conversation_trie": OP11,
        "op12_spelling_tiles": OP12,
    }
