"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_trie, decontaminate, embedding_dedup, jaccard_join, kneser_ney, licenses, line_dedup, mixing, sharding, spelling, token_ids, toxicity
from .common import table


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        """SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
           FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.parse_chats(chat.format_chats(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _op4_sql() -> str:
    def esc(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for s in chat.CONTROL_STRINGS:
            out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
        return out

    head, tail = len(chat.OPEN) + len(chat.BREAK), len(chat.CLOSE)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, {head} + length(replace({esc("role")}, chr(10), '\\' || chr(10))) + length({esc("text")}) + {tail} AS chars FROM rows),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(chars) AS chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM chats"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_ids.write_token_ids(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_ids.read_token_digest(spark, path)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labelled table calls good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, shingle=5)


_WORDS_SQL = r"list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda w: w <> '')"

OP7_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
item_grams AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
         lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS g FROM item_words WHERE len(w) > 0),
items AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS q FROM item_grams),
doc_words AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM items),
doc_grams AS (
  SELECT DISTINCT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g
  FROM doc_words CROSS JOIN sizes WHERE len(w) >= size)
SELECT doc_id, item_id, count(*) AS shared, max(q) AS item_shingles, count(*) / max(q) AS containment
FROM doc_grams JOIN items USING (size, g) GROUP BY doc_id, item_id HAVING count(*) / max(q) >= 0.8"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_in", "lines_out")


# All pairs of equal lines, chained along diagonals into runs: no windows and no first places.
OP1_SQL = r"""
WITH raw AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
norm AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS n, regexp_matches(line, '[\p{L}\p{N}]') AS "full" FROM raw),
lines AS (
  SELECT doc_id, pos, n, len(string_split(n, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM norm WHERE "full"),
equal AS (
  SELECT a.doc_id, b.doc_id AS earlier, a.seq - b.seq AS shift, a.pos, a.words,
         a.seq - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.seq - b.seq ORDER BY a.seq) AS island
  FROM lines a JOIN lines b ON a.n = b.n AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))),
sized AS (SELECT doc_id, pos, count(*) OVER run AS n, sum(words) OVER run AS words FROM equal WINDOW run AS (PARTITION BY doc_id, earlier, shift, island)),
gone AS (SELECT DISTINCT doc_id, pos, TRUE AS gone FROM sized WHERE n >= 4 OR words >= 50)
SELECT doc_id,
       CASE WHEN bool_or(gone) AND NOT bool_or("full" AND gone IS NULL) THEN ''
            ELSE string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL) END AS text,
       count(*) AS lines_in, count(*) FILTER (WHERE gone IS NULL) AS lines_out
FROM norm LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id"""


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.cosine_components(table(spark, sf_dir, "embeddings"), threshold=0.9)


# Expression of the components: the smallest id over paths of links.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach(vec_id, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.low < l.b),
lows AS (SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM lows LEFT JOIN counts USING (vec_id)"""


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the labelled table: toxic, or else good or junk."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("junk")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


TARGET_WEIGHTS = {"good": 0.92, "toxic": 0.06, "junk": 0.02}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGET_WEIGHTS)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"), threshold=0.8)


def _op8_sql() -> str:
    named = [("BSD-2-Clause OR BSD-3-Clause" if text == licenses.BSD_HEADING else name, text) for name, text in licenses.TEMPLATES]
    templates = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in [*named, *licenses.WHOLE_TEMPLATES])
    grams = (
        "list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
    )
    return f"""
WITH templates(license, text) AS (VALUES {templates}),
t AS (SELECT row_number() OVER () AS tid, license, {grams} AS grams FROM (SELECT license, {_WORDS_SQL} AS w FROM templates)),
lines AS (SELECT doc_id, 'line' AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS text FROM documents),
parts AS (SELECT doc_id, string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*') AS p, text FROM documents),
paragraphs AS (SELECT doc_id, 'paragraph' AS unit, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS text FROM parts),
passages AS (
  SELECT * FROM lines UNION ALL SELECT * FROM paragraphs WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM parts WHERE len(p) > 1),
sets AS (SELECT doc_id, unit, place, {grams} AS grams FROM (SELECT doc_id, unit, place, {_WORDS_SQL} AS w FROM passages) WHERE len(w) > 0),
own AS (SELECT doc_id, unit, place, len(grams) AS n, unnest(grams) AS g FROM sets),
theirs AS (SELECT tid, license, len(grams) AS tn, unnest(grams) AS g FROM t),
shared AS (
  SELECT doc_id, unit, place, license, 2 * count(*) / (n + tn) AS dice
  FROM own JOIN theirs USING (g) GROUP BY doc_id, unit, place, n, tid, license, tn)
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, dice
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) AS k FROM shared WHERE dice >= 0.8) WHERE k = 1"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The crc32 of bytes: s is the start value, then for each byte the byte and eight times -1, a step of the division.
_CRC_SQL = "xor(list_reduce(s, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"

# Whole paths as lists; subtrees are the nodes whose paths begin with a node's own.
OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
steps AS (SELECT c, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT]))) AS s FROM ids),
crc AS (SELECT c, c - c % 100 AS base, @CRC@ % 6 AS h FROM steps),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT crc.c, 0 AS part, pos, sha256(role || chr(1) || text) AS item, length(text) AS chars FROM crc JOIN t ON t.c = base AND pos < h
  UNION ALL SELECT crc.c, 1, pos, sha256(role || chr(1) || text), length(text) FROM crc JOIN t ON t.c = crc.c AND pos >= h),
path AS (SELECT c, row_number() OVER w AS d, list(item) OVER w AS p, chars FROM built WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
member AS (SELECT c, d, p, chars FROM path UNION ALL SELECT c, 0, CAST([] AS VARCHAR[]), 0 FROM ids),
last AS (SELECT c, max(d) AS d FROM member GROUP BY c),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM member JOIN last USING (c, d) GROUP BY p),
node AS (SELECT p, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars, CASE WHEN d > 0 THEN p[1:d - 1] END AS up FROM member GROUP BY p, d),
kid AS (SELECT up, count(*) AS kids FROM node WHERE d > 0 GROUP BY up),
n AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kid ON kid.up = node.p),
sub AS (SELECT a.p, count(*) FILTER (WHERE b.kids = 0) AS leaves, sum((b.n - 1) * b.chars) AS saved FROM n a JOIN n b ON b.d >= a.d AND (a.d = 0 OR b.p[1:a.d] = a.p) GROUP BY a.p)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM n JOIN sub ON sub.p = n.p LEFT JOIN node u ON u.p = n.up LEFT JOIN ends ON ends.p = n.p""".replace("@CRC@", _CRC_SQL)

# Words one edit apart lose one letter at one place to the same rest, or one of them loses a letter to the other.
OP12_SQL = r"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents WHERE text IS NOT NULL),
seen AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
steps AS (SELECT *, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] ELSE [195::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, unicode(x) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END))) AS s FROM seen),
crc AS (SELECT w, n, @CRC@ AS h FROM steps),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT less.word, v.word FROM less JOIN v ON v.word = less.short UNION SELECT v.word, less.word FROM less JOIN v ON v.word = less.short),
best AS (SELECT a, v.word, v.n, count(*) OVER (PARTITION BY a) AS near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, v.word) AS k FROM pairs JOIN v ON v.word = b),
f AS (SELECT v.word, v.n, coalesce(near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN best.word END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.a = v.word AND k = 1),
walk(word, here) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
root AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN root USING (word)""".replace("@CRC@", _CRC_SQL)


QUERIES = {
    "op11_conversation_trie": op11_conversation_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
    "op8_license_scan": op8_license_scan,
    "op2_mixing": op2_mixing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op1_line_dedup": op1_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op3_token_ids": op3_token_ids,
    "op5_jaccard_join": op5_jaccard_join,
    "op4_chat_formatting": op4_chat_formatting,
    "op9_sharding": op9_sharding,
}
ORACLES = {
    "op11_conversation_trie": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op8_license_scan": _op8_sql(),
    "op10_embedding_dedup": OP10_SQL,
    "op1_line_dedup": OP1_SQL,
    "op7_decontamination": OP7_SQL,
    "op4_chat_formatting": _op4_sql(),
}
