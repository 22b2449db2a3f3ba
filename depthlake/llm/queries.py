"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digest
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle_digest
from .language_id import language_scores
from .merkle import manifest_digest
from .packing import packed_pieces
from .quality import quality_scores
from .secret_scan import secret_digest
from .shared import read_documents
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .syncmers import edited_fingerprints
from .token_files import read_token_files, token_digest, write_token_files
from .toxicity import toxicity_scores

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read_documents(spark, sf_dir), BYTE_VOCABULARY)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(read_documents(spark, sf_dir), WORD_VOCABULARY, keeps_spaces=False)
    return token_digest(read_token_files(spark, path))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read_documents(spark, sf_dir), BYTE_VOCABULARY)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(read_documents(spark, sf_dir))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(read_documents(spark, sf_dir))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_syncmers": op2_syncmers,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_bpe": op9_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle": op11_merkle,
    "op12_language_id": op12_language_id,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: CTEs for CRC-32 in SQL, for texts of 20 bytes at most: cz(d, b, v) is what byte b adds with d bytes after it, ci(n, v) the register after n zero bytes. A checksum is the xor of the shares of all bytes and the length.
_CRC = """cb AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM cb WHERE k < 8),
ct AS (SELECT b, v FROM cb WHERE k = 8),
cz AS (SELECT 0 AS d, b, v FROM ct UNION ALL SELECT d + 1, cz.b, xor(ct.v, cz.v >> 8) FROM cz JOIN ct ON ct.b = cz.v & 255 WHERE d < 20),
ci AS (SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS v UNION ALL SELECT n + 1, xor(ct.v, ci.v >> 8) FROM ci JOIN ct ON ct.b = ci.v & 255 WHERE n < 20)"""

#: The other operators hold hashes, models, tokenizers or windows over all bytes, which SQL can't express or is too slow for; they are tested against brute force.
ORACLE_SQL = {
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
m AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS mid FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size, min(doc_id) AS first_id FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, first_id <= mid AS in_history FROM d JOIN g USING (h), m""",
    "op11_merkle": f"""WITH RECURSIVE {_CRC},
ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL), bt AS (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM ids),
cr AS (SELECT t, xor(bit_xor(cz.v), xor(max(ci.v), 4294967295)) AS crc FROM bt JOIN cz ON cz.d = length(t) - i AND cz.b = ascii(substring(t, CAST(i AS INTEGER), 1)) JOIN ci ON ci.n = length(t) GROUP BY t),
f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS b FROM documents),
lf AS (SELECT doc_id, lang, sha256(a || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || b) AS leaf, sha256(a || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || b) AS longer FROM f),
pl AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM lf),
lv AS (SELECT CAST(tree AS BIGINT) AS tree, 0 AS level, CAST(pos AS BIGINT) AS pos, leaf AS node, CAST(n AS BIGINT) AS n FROM pl
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(node || coalesce(nx, '')), (n + 1) // 2 FROM (SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY pos) AS nx FROM lv WHERE n > 1) WHERE pos % 2 = 0),
sr AS (SELECT tree, node, level FROM lv WHERE n = 1), tc AS (SELECT count(*) AS trees FROM sr),
tp AS (SELECT 0 AS level, tree - 1 AS pos, node, trees AS n FROM sr, tc
  UNION ALL SELECT level + 1, pos // 2, sha256(node || coalesce(nx, '')), (n + 1) // 2 FROM (SELECT *, lead(node) OVER (ORDER BY pos) AS nx FROM tp WHERE n > 1) WHERE pos % 2 = 0),
rt AS (SELECT node AS root, level AS high FROM tp WHERE n = 1),
nd AS (SELECT tree, level, pos, node FROM lv UNION ALL SELECT 0, level, pos, node FROM tp),
st AS (SELECT pl.doc_id, pl.leaf, pl.tree, pl.pos, sr.node AS subroot, sr.level AS own, root, own + high AS steps,
  CASE WHEN crc % 7 = 0 THEN coalesce(longer, leaf) ELSE leaf END AS offered, row_number() OVER () AS id FROM pl JOIN sr ON sr.tree = pl.tree LEFT JOIN cr ON cr.t = CAST(doc_id AS VARCHAR), rt),
wk AS (SELECT id, 0 AS step, CASE WHEN own = 0 THEN 0 ELSE CAST(tree AS BIGINT) END AS tree, CASE WHEN own = 0 THEN CAST(tree AS BIGINT) - 1 ELSE CAST(pos AS BIGINT) END AS pos, offered AS h, '' AS proof, st.steps, st.own, CAST(st.tree AS BIGINT) AS home FROM st
  UNION ALL SELECT id, step + 1, CASE WHEN step + 1 >= own THEN 0 ELSE wk.tree END, CASE WHEN step + 1 = own THEN home - 1 ELSE wk.pos // 2 END, sha256(CASE WHEN wk.pos % 2 = 1 THEN coalesce(nd.node, '') || h ELSE h || coalesce(nd.node, '') END), proof || coalesce(nd.node, ''), steps, own, home
  FROM wk LEFT JOIN nd ON nd.tree = wk.tree AND nd.level = CASE WHEN wk.tree = 0 THEN step - own ELSE step END AND nd.pos = xor(wk.pos, 1) WHERE step < steps)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM st JOIN wk USING (id) WHERE step = st.steps""",
    "op13_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substring(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substring(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substring(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substring(h, 25, 8) AS BIGINT) % 100 AS d FROM t),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q, CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, substring(x, 1, p) AS pre, substring(x, p + 1, q - p) AS mid, substring(x, q + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM s""",
}
